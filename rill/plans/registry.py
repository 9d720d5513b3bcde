"""Registered queries over the test tables, each with its SQL equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions, fields, scalar
from ..operators import blocks, calc, joins, rows, trees
from ..sources import generate, records

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(*cols: str, n: int = 3):
    return [F.round(c, n).alias(c) for c in cols]


def queries() -> dict:
    from . import more  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return calc_by_flags(spark, sf)


# --- statistics


@query("""select l_returnflag, l_linestatus, round(min(l_quantity),3) as l_quantity_min, round(max(l_quantity),3) as l_quantity_max, round(sum(l_quantity),3) as l_quantity_sum,
round(avg(l_quantity),3) as l_quantity_mean, round(var_pop(l_quantity),3) as l_quantity_var, round(stddev_samp(l_quantity),3) as l_quantity_stddev_sample, count(l_quantity) as l_quantity_size,
round(max(l_quantity)-min(l_quantity),3) as l_quantity_diameter, round((max(l_quantity)-min(l_quantity))/2,3) as l_quantity_radius, round((min(l_quantity)+max(l_quantity))/2,3) as l_quantity_centre
from lineitem group by all""")
def calc_by_flags(spark, sf):
    out = calc.calc(_t(spark, sf, "lineitem"), ["min", "max", "sum", "mean", "var", "stddev=sample", "size", "diameter", "radius", "centre"], ["l_quantity"], ["l_returnflag", "l_linestatus"])
    return out.select(*(F.round(c, 3).alias(c) if t == "double" else c for c, t in out.dtypes))


@query("""with m as (select l_returnflag, avg(l_tax) as mu, count(*) as n from lineitem group by 1),
s as (select l.l_returnflag, any_value(n) as n, avg((l_tax-mu)**2) as m2, avg((l_tax-mu)**3) as m3, avg((l_tax-mu)**4) as m4 from lineitem l join m using (l_returnflag) group by 1)
select l_returnflag, round(m3/m2**1.5,3) as l_tax_skew, round(m4/m2**2,3) as l_tax_kurtosis, round(m3/m2**1.5*sqrt(n*(n-1.0))/(n-2),3) as l_tax_skew_sample, round(m4/m2**2-3,3) as l_tax_kurtosis_excess from s""")
def calc_moments(spark, sf):
    out = calc.calc(_t(spark, sf, "lineitem"), ["skew", "kurtosis", "skew=sample", "kurtosis=excess"], ["l_tax"], ["l_returnflag"])
    return out.select("l_returnflag", *_r(*out.columns[1:]))


@query("""with r as (select user_id, value, row_number() over (partition by user_id order by value) as i, count(*) over (partition by user_id) as n from events),
p as (select user_id, any_value(n) as n, any_value(0.4*(n+1)) as pl from r group by 1),
v as (select p.user_id, n, pl, (select any_value(value) from r where r.user_id=p.user_id and i=greatest(1,floor(pl))) as a, (select any_value(value) from r where r.user_id=p.user_id and i=least(p.n,floor(pl)+1)) as b,
 (select min(value) from r where r.user_id=p.user_id) as lo, (select max(value) from r where r.user_id=p.user_id) as hi, (select any_value(value) from r where r.user_id=p.user_id and i=ceil(p.n*0.9)) as near from p)
select user_id, near as value_percentile_0_9, round(case when pl<=1 then lo when pl>=n then hi else a+(pl-floor(pl))*(b-a) end,3) as value_percentile_0_4_interpolate from v""")
def calc_percentiles(spark, sf):
    out = calc.calc(_t(spark, sf, "events"), ["percentile=0.9", "percentile=0.4:interpolate"], ["value"], ["user_id"])
    return out.select("user_id", "value_percentile_0_9", *_r("value_percentile_0_4_interpolate"))


@query("select l_suppkey, max(l_extendedprice) as l_extendedprice_max from lineitem group by 1")
def calc_grouped_max(spark, sf):
    return calc.calc(_t(spark, sf, "lineitem"), ["max"], ["l_extendedprice"], ["l_suppkey"])


@query("select o_orderkey, o_custkey, max(o_totalprice) over (partition by o_custkey) as o_totalprice_max, count(o_totalprice) over (partition by o_custkey) as o_totalprice_size from orders")
def calc_append(spark, sf):
    return calc.calc_append(_t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["max", "size"], ["o_totalprice"], ["o_custkey"]).drop("o_totalprice")


@query("select o_custkey, min(o_orderkey) as o_orderkey, max(o_totalprice) as o_totalprice_max from orders group by 1")
def calc_append_once(spark, sf):
    df = _t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return calc.calc_append(df, ["max"], ["o_totalprice"], ["o_custkey"], once_in_order=["o_orderkey"]).drop("o_totalprice")


@query("with c as (select user_id, event_type, count(*) as n from events group by all) select user_id, arg_min(event_type, (-n, event_type)) as event_type_mode from c group by 1")
def calc_mode(spark, sf):
    return calc.calc(_t(spark, sf, "events"), ["mode"], ["event_type"], ["user_id"])


# --- selection


@query("select o_orderkey, o_totalprice from orders where o_totalprice >= 50000 and o_totalprice <= 150000 and o_orderstatus <> 'F'")
def select_range(spark, sf):
    p = F.col("o_totalprice")
    return rows.select_records(_t(spark, sf, "orders"), [p >= 50000, p <= 150000, F.col("o_orderstatus") != "F"]).select("o_orderkey", "o_totalprice")


@query("select o_orderkey, case when o_totalprice < 20000 or regexp_matches(o_orderpriority, '^[12]') then 1 else 0 end as matches from orders")
def select_any_flag(spark, sf):
    return rows.select_records(_t(spark, sf, "orders"), [F.col("o_totalprice") < 20000, F.col("o_orderpriority").rlike("^[12]")], any_of=True, flag="matches").select("o_orderkey", "matches")


@query("select o_orderkey from orders where not (o_orderstatus = 'O')")
def select_not_matching(spark, sf):
    return rows.select_records(_t(spark, sf, "orders"), [F.col("o_orderstatus") == "O"], invert=True).select("o_orderkey")


@query("select event_id from (select *, row_number() over (partition by user_id order by ts) as n from events) where floor(n*0.25+1e-9) > floor((n-1)*0.25+1e-9)")
def thin_deterministic(spark, sf):
    return rows.thin(_t(spark, sf, "events"), 0.25, ["user_id"], ["ts"]).select("event_id")


@query("""with g as (select event_id, user_id, ts, floor((epoch_us(ts) - first_value(epoch_us(ts)) over w)/3600000000.0) as k from events window w as (partition by user_id order by ts)),
h as (select *, max(k) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) as top from g) select event_id from h where top is null or k > top""")
def thin_by_time(spark, sf):
    return rows.thin_by_time(_t(spark, sf, "events"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 3600.0, ["user_id"], ["ts"]).select("event_id")


@query("select event_id, user_id from (select *, max(case when value > 95 then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as d from events) where d = 0")
def take_until(spark, sf):
    return blocks.read_until(_t(spark, sf, "events"), F.col("value") > 95, ["user_id"], ["ts"], inclusive=False).select("event_id", "user_id")


# --- joins


@query("select n_name, s_suppkey from supplier join nation on s_nationkey = n_nationkey")
def join_equal(spark, sf):
    n = _t(spark, sf, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return joins.equal(_t(spark, sf, "supplier"), n, ["s_nationkey"]).select("n_name", "s_suppkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 100000)")
def join_matching(spark, sf):
    big = _t(spark, sf, "orders").filter("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.matching(_t(spark, sf, "customer"), big, ["c_custkey"]).select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_not_matching(spark, sf):
    keys = _t(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.not_matching(_t(spark, sf, "customer"), keys, ["c_custkey"]).select("c_custkey")


@query("select c_custkey, case when c_custkey in (select o_custkey from orders where o_orderstatus='F') then 1 else 0 end as matching from customer")
def join_flag(spark, sf):
    keys = _t(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.flag_matching(_t(spark, sf, "customer"), keys, ["c_custkey"]).select("c_custkey", "matching")


@query("select c_custkey, min(o_orderkey) as o_orderkey from customer join orders on c_custkey=o_custkey group by 1")
def join_first_matching(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.first_matching(_t(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], ["c_custkey"], ["o_orderkey"])


@query("select s_suppkey, c_custkey from supplier, customer where abs(s_acctbal - c_acctbal) <= 5")
def join_radius(spark, sf):
    return joins.radius_join(_t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), _t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 5.0).select("s_suppkey", "c_custkey")


@query("with p as (select s_suppkey, c_custkey, c_acctbal, rank() over (partition by s_suppkey order by abs(s_acctbal-c_acctbal), c_acctbal) as r from supplier, customer where abs(s_acctbal - c_acctbal) <= 50) select s_suppkey, c_custkey from p where r=1")
def join_radius_nearest(spark, sf):
    return joins.radius_join(_t(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), _t(spark, sf, "customer").select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 50.0, nearest=["s_suppkey"]).select("s_suppkey", "c_custkey")


def _sides(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    kinds = "event_type = 'purchase'"
    return e.filter(f"not {kinds}").drop("event_type"), e.filter(kinds).select(F.col("event_id").alias("bound_id"), "user_id", F.col("ts").alias("bound_ts"))


_ASOF = "select a.event_id, b.event_id as bound_id from (select * from events where event_type <> 'purchase') a asof join (select * from events where event_type = 'purchase') b on a.user_id=b.user_id and "


@query(_ASOF + "a.ts >= b.ts")
def time_join_lower(spark, sf):
    a, b = _sides(spark, sf)
    return joins.time_join(a, b, "ts", "bound_ts", ["user_id"]).select("event_id", "bound.bound_id")


@query(_ASOF + "a.ts < b.ts")
def time_join_upper(spark, sf):
    a, b = _sides(spark, sf)
    return joins.time_join(a, b, "ts", "bound_ts", ["user_id"], "upper").select("event_id", "bound.bound_id")


@query("""with a as (select * from events where event_type <> 'purchase'), b as (select * from events where event_type = 'purchase'),
lo as (select a.event_id, b.event_id as i, epoch_us(a.ts)-epoch_us(b.ts) as d from a asof join b on a.user_id=b.user_id and a.ts>=b.ts),
hi as (select a.event_id, b.event_id as i, epoch_us(b.ts)-epoch_us(a.ts) as d from a asof join b on a.user_id=b.user_id and a.ts<b.ts)
select a.event_id, case when hi.i is null or lo.d < hi.d then lo.i else hi.i end as bound_id from a left join lo using (event_id) left join hi using (event_id) where lo.i is not null or hi.i is not null""")
def time_join_nearest(spark, sf):
    a, b = _sides(spark, sf)
    return joins.time_join(a, b, "ts", "bound_ts", ["user_id"], "nearest").select("event_id", "bound.bound_id")


@query(_ASOF + "a.ts >= b.ts where a.ts - b.ts <= interval 1 day")
def time_join_bound(spark, sf):
    a, b = _sides(spark, sf)
    near = F.col("ts") - F.col("bound.bound_ts") <= F.expr("interval 1 day")
    return joins.time_join(a, b, "ts", "bound_ts", ["user_id"], within=near).select("event_id", "bound.bound_id")


def _spans(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", (F.col("p_retailprice") * 100).alias("low"), (F.col("p_retailprice") * 100 + 30).alias("high"))


@query("select o_orderkey, p_partkey from orders, part where o_totalprice >= p_retailprice*100 and o_totalprice < p_retailprice*100 + 30")
def interval_join(spark, sf):
    return joins.interval_join(_t(spark, sf, "orders"), _spans(spark, sf), "o_totalprice", "low", "high", 40.0).select("o_orderkey", "p_partkey")


@query("""with s as (select user_id, epoch_us(ts)//1000000 as f, epoch_us(ts)//1000000 + 86400 as t from events), p as (select user_id, f as x, 1 as s from s union all select user_id, t, -1 from s),
g as (select user_id, x, sum(s) as s from p group by all), e as (select user_id, x as "from", lead(x) over w as "to", sum(s) over w as overlap from g window w as (partition by user_id order by x))
select user_id, "from", "to", overlap::bigint as overlap from e where overlap > 0 and "to" is not null""")
def interval_split(spark, sf):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return joins.elementary_intervals(_t(spark, sf, "events").select("user_id", at.alias("low"), (at + 86400).alias("high")), "low", "high", ["user_id"])


@query("""with o as (select conv_id, turn, length(text) as n from conversations), b as (select conv_id, turn, n from o where turn % 3 = 0)
select a.conv_id, a.turn, b.n as stop_n from o a asof join b on a.conv_id=b.conv_id and a.turn >= b.turn""")
def join_block_less(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn")
    stops = _t(spark, sf, "conversations").filter("turn % 3 = 0").select("conv_id", "turn", F.length("text").alias("stop_n"))
    return joins.block_less(c, stops, "turn", ["conv_id"], []).select("conv_id", "turn", "stop_n")


@query("""with recursive e as (select event_id, user_id, event_type as event, row_number() over (partition by user_id order by ts) as i from events), m(event, state, next_state) as (values ('view', 0, 1), ('click', 1, 2), ('purchase', 2, 0), ('click', 0, 2)),
f as (select user_id, 0::bigint as i, 0 as state, null::bigint as event_id, null::integer as next_state, 0 as now from (select distinct user_id from e) union all
select e.user_id, e.i, f.now, e.event_id, m.next_state, coalesce(m.next_state, f.now) from f join e on e.user_id = f.user_id and e.i = f.i + 1 left join m on m.event = e.event and m.state = f.now)
select event_id, state, next_state from f where next_state is not null""")
def join_state_machine(spark, sf):
    moves = spark.createDataFrame([("view", 0, 1), ("click", 1, 2), ("purchase", 2, 0), ("click", 0, 2)], "event string, state int, next_state int")
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", F.col("event_type").alias("event"))
    return joins.state_join(e, moves, 0, ["user_id"], ["ts"]).select("event_id", "state", "next_state")


# --- updates, sorts, deduplication


@query("select user_id, event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by ts rows between unbounded preceding and current row) as value from events")
def update_running(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", "ts", F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return rows.running_update(e, ["value"], ["user_id"], ["ts"]).drop("ts")


@query("select user_id, arg_max(value, ts) as value, arg_max(event_type, ts) as event_type from events group by 1")
def update_last_only(spark, sf):
    return rows.running_update(_t(spark, sf, "events"), ["value", "event_type"], ["user_id"], ["ts"], last_only=True)


@query("""with u as (select n_nationkey + 10 as k, n_name as v from nation), s as (select n_nationkey as k, cast(n_regionkey as varchar) as v from nation)
select s.k, coalesce(u.v, s.v) as v from s left join u using (k) union all select u.k, u.v from u where k not in (select k from s)""")
def update_from_file(spark, sf):
    n = _t(spark, sf, "nation")
    return rows.update_from(n.select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("string").alias("v")), n.select((F.col("n_nationkey") + 10).alias("k"), F.col("n_name").alias("v")), ["k"], ["v"])


@query("select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by all")
def sort_first(spark, sf):
    return rows.keep_first(_t(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("select o_orderkey, o_custkey from orders order by o_custkey desc, o_orderkey limit 100")
def sort_head(spark, sf):
    return rows.head(_t(spark, sf, "orders").select("o_orderkey", "o_custkey"), 100, [F.col("o_custkey").desc(), "o_orderkey"])


@query("""select o_orderkey, o_custkey, case when o_totalprice = mn then 'min' else 'max' end as side from (select *, min(o_totalprice) over (partition by o_custkey) as mn, max(o_totalprice) over (partition by o_custkey) as mx from orders)
where o_totalprice in (mn, mx)""")
def sort_min_max(spark, sf):
    return rows.extremes(_t(spark, sf, "orders"), "o_totalprice", ["o_custkey"]).select("o_orderkey", "o_custkey", "side")


@query("select event_id from (select *, max(value) over (partition by user_id order by ts rows between unbounded preceding and 1 preceding) as top from events) where top is null or value >= top")
def sort_discard_out_of_order(spark, sf):
    return rows.in_order(_t(spark, sf, "events"), "value", ["user_id"], ["ts"]).select("event_id")


@query("with g as (select event_type, min(event_id) as f, count(*) as count from events group by 1) select event_type, count, row_number() over (order by f) - 1 as id from g")
def enumerate_map(spark, sf):
    return rows.enumerate_keys(_t(spark, sf, "events"), ["event_type"], ["event_id"])


# --- blocks and windows


@query("""with c as (select event_id, user_id, ts, case when row_number() over w > 1 and event_type is distinct from lag(event_type) over w then 1 else 0 end as c from events window w as (partition by user_id order by ts))
select event_id, sum(c) over (partition by user_id order by ts)::bigint as block from c""")
def blocks_by_change(spark, sf):
    return blocks.group_by_change(_t(spark, sf, "events"), ["event_type"], ["user_id"], ["ts"]).select("event_id", "block")


@query("""with c as (select event_id, user_id, ts, case when epoch_us(ts) - lag(epoch_us(ts)) over w >= 86400000000 then 1 else 0 end as c from events window w as (partition by user_id order by ts))
select event_id, sum(c) over (partition by user_id order by ts)::bigint as block from c""")
def blocks_by_gap(spark, sf):
    return blocks.group_by_gap(_t(spark, sf, "events"), F.unix_micros(F.col("ts").cast("timestamp")), 86400e6, ["user_id"], ["ts"]).select("event_id", "block")


@query("""with recursive e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts) as i from events),
f as (select event_id, user_id, i, value as start, 0::bigint as block from e where i = 1 union all
select e.event_id, e.user_id, e.i, case when abs(e.value - f.start) >= 30 then e.value else f.start end, f.block + case when abs(e.value - f.start) >= 30 then 1 else 0 end from f join e on e.user_id=f.user_id and e.i=f.i+1)
select event_id, block from f""")
def blocks_by_span(spark, sf):
    return blocks.group_by_span(_t(spark, sf, "events"), "value", 30.0, ["user_id"], ["ts"]).select("event_id", "block")


@query("""with c as (select event_id, user_id, ts, case when lag(value between 20 and 80) over w <> (value between 20 and 80) then 1 else 0 end as c from events window w as (partition by user_id order by ts))
select event_id, sum(c) over (partition by user_id order by ts)::bigint as block from c""")
def blocks_by_range(spark, sf):
    return blocks.group_by_range(_t(spark, sf, "events"), F.col("value"), 20, 80, ["user_id"], ["ts"]).select("event_id", "block")


@query("select conv_id, turn, count(*) over (partition by conv_id) - row_number() over (partition by conv_id order by turn) as index from conversations")
def blocks_index_reverse(spark, sf):
    return blocks.index(_t(spark, sf, "conversations"), ["conv_id"], ["turn"], reverse=True).select("conv_id", "turn", "index")


@query("select conv_id, turn from (select *, dense_rank() over (partition by conv_id order by turn // 2) as r from conversations) where r <= 2")
def blocks_head(spark, sf):
    return blocks.head(_t(spark, sf, "conversations").withColumn("pair", F.floor(F.col("turn") / 2)), 2, "pair", ["conv_id"]).select("conv_id", "turn")


@query("""with e as (select event_id, user_id, row_number() over (partition by user_id order by ts) - 1 as i, count(*) over (partition by user_id) as n from events)
select event_id, w as window from (select event_id, unnest(generate_series(greatest(0, ceil((i-3)/2.0))::bigint, least(floor(i/2), floor((n-4)/2.0))::bigint)) as w from e)""")
def shape_sliding_window(spark, sf):
    return rows.sliding_rows(_t(spark, sf, "events"), 4, 2, ["user_id"], ["ts"]).select("event_id", "window")


@query("""select event_id, event_type as event_type_0, b as event_type_1, c as event_type_2 from
(select *, lead(event_type) over w as b, lead(event_type, 2) over w as c, row_number() over w as i, count(*) over (partition by user_id) as n from events window w as (partition by user_id order by ts)) where i + 2 <= n""")
def shape_concatenate(spark, sf):
    return rows.concatenate(_t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "event_type", 3, ["user_id"], ["ts"]).drop("user_id", "ts", "event_type")


@query("""select event_id, event_type as event_type_0, coalesce(lead(event_type) over w, first_value(event_type) over w) as event_type_1 from events window w as (partition by user_id order by ts)""")
def shape_loop(spark, sf):
    return rows.concatenate(_t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type"), "event_type", 2, ["user_id"], ["ts"], wrap=True).drop("user_id", "ts", "event_type")


@query("select n_nationkey, unnest([0,1,2]) as copy from nation")
def shape_repeat(spark, sf):
    return rows.repeat_rows(_t(spark, sf, "nation").select("n_nationkey"), 3)


# copies at each step up to the next record's time, and at that time itself, if it is a step away or more
@query("""with e as (select event_id, epoch_us(ts) as t, epoch_us(lead(ts) over (partition by user_id order by ts)) as u, 21600000000 as p from events),
r as (select event_id, t, 0 as repeated from e union all
select event_id, unnest(generate_series(t + p, u, p)), 1 from e where u >= t + p union all
select event_id, u, 1 from e where u >= t + p and (u - t) % p <> 0)
select event_id, make_timestamp(t) as at, repeated from r""")
def repeat_fill(spark, sf):
    return rows.fill_holes(_t(spark, sf, "events"), "ts", 21600.0, ["user_id"], ["ts"]).select("event_id", "at", "repeated")


@query("""with a as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as i from conversations where role='user'), b as (select conv_id, length(text) as n, row_number() over (partition by conv_id order by turn) as i from conversations where role<>'user')
select a.conv_id, a.turn, b.n from a join b using (conv_id, i)""")
def paste_streams(spark, sf):
    c = _t(spark, sf, "conversations")
    a, b = c.filter("role = 'user'").select("conv_id", "turn"), c.filter("role <> 'user'").select("conv_id", F.col("turn").alias("t"), F.length("text").alias("n"))
    return rows.paste([a, b], [["turn"], ["t"]], ["conv_id"]).drop("t")


# --- expressions and scalar functions


@query("select event_id, round(value*2+1,3) as x, case when value > 50 then 1 else 0 end as high, round(least(greatest(value,10),90),3) as c, round(sqrt(value**2),3) as r from events")
def eval_expressions(spark, sf):
    out = expressions.evaluate(_t(spark, sf, "events").select("event_id", "value"), "x=value*2+1;high=where(value>50,1,0);c=clip(value,10,90);r=sqrt(value**2)")
    return out.select("event_id", F.round("x", 3).alias("x"), "high", F.round("c", 3).alias("c"), F.round("r", 3).alias("r"))


@query("select round(sum(x),1) as x, round(sum(y),1) as y from (select l_extendedprice + l_tax as x, l_extendedprice - l_tax as y from lineitem)")
def eval_row_wise(spark, sf):
    out = expressions.evaluate(_t(spark, sf, "lineitem").select("l_extendedprice", "l_tax"), "x=l_extendedprice+l_tax;y=l_extendedprice-l_tax")
    return out.agg(F.round(F.sum("x"), 1).alias("x"), F.round(F.sum("y"), 1).alias("y"))


@query("select event_id from events where value > 25 and value % 2 < 1")
def eval_select(spark, sf):
    e = _t(spark, sf, "events")
    return e.filter(expressions.condition(e, "logical_and(value > 25, value % 2 < 1)")).select("event_id")


@query("select page_id, list_extract(string_split(url,'/'), -1) as base, array_to_string(string_split(url,'/')[1:-2],'/') as dir from pages where len(string_split(url,'/')) > 1")
def strings_paths(spark, sf):
    return _t(spark, sf, "pages").filter(F.size(F.split("url", "/")) > 1).select("page_id", scalar.path_basename(F.col("url")).alias("base"), scalar.path_dirname(F.col("url")).alias("dir"))


@query("select o_orderkey, strftime(o_orderdate, '%Y%m%dT%H%M%S') as iso, o_orderdate - interval 90 second as earlier, case when o_orderdate < timestamp '1999-01-01' then null when o_orderdate < timestamp '2006-01-01' then 32 else 33 end as tai from orders where o_orderdate < timestamp '2009-01-01'")
def time_formats(spark, sf):
    t = F.col("o_orderdate")
    o = _t(spark, sf, "orders").filter(t < F.lit("2009-01-01").cast("timestamp_ntz"))
    tai = F.when(t >= F.lit("1999-01-01").cast("timestamp_ntz"), scalar.tai_offset(t))  # null before, as its SQL has it; time_tai has all
    return o.select("o_orderkey", scalar.iso(t).alias("iso"), scalar.delay(t, -90).alias("earlier"), tai.alias("tai"))


@query("select o_orderkey, coalesce((select max(s) from (values (timestamp '1972-01-01', 10), (timestamp '1972-07-01', 11), (timestamp '1973-01-01', 12), (timestamp '1974-01-01', 13), (timestamp '1975-01-01', 14), (timestamp '1976-01-01', 15), (timestamp '1977-01-01', 16), (timestamp '1978-01-01', 17), (timestamp '1979-01-01', 18), (timestamp '1980-01-01', 19), (timestamp '1981-07-01', 20), (timestamp '1982-07-01', 21), (timestamp '1983-07-01', 22), (timestamp '1985-07-01', 23), (timestamp '1988-01-01', 24), (timestamp '1990-01-01', 25), (timestamp '1991-01-01', 26), (timestamp '1992-07-01', 27), (timestamp '1993-07-01', 28), (timestamp '1994-07-01', 29), (timestamp '1996-01-01', 30), (timestamp '1997-07-01', 31), (timestamp '1999-01-01', 32), (timestamp '2006-01-01', 33), (timestamp '2009-01-01', 34), (timestamp '2012-07-01', 35), (timestamp '2015-07-01', 36), (timestamp '2017-01-01', 37)) v(day, s) where day <= o_orderdate), 0) as tai from orders")
def time_tai(spark, sf):
    return _t(spark, sf, "orders").select("o_orderkey", scalar.tai_offset(F.col("o_orderdate")).alias("tai"))


@query("select event_id, ts as t from events")
def time_parse(spark, sf):
    return _t(spark, sf, "events").select("event_id", scalar.parse_time(scalar.iso(F.col("ts"))).alias("t"))


@query("select p_partkey, round(p_size*0.3048::double,4) as metres, round((p_size+459.67::double)*5/9-273.15::double,4) as celsius, round(p_size*3.141592653589793::double/180,4) as radians from part")
def units_convert(spark, sf):
    x = F.col("p_size")
    return _t(spark, sf, "part").select("p_partkey", F.round(scalar.convert(x, "feet", "metres"), 4).alias("metres"), F.round(scalar.convert(x, "fahrenheit", "celsius"), 4).alias("celsius"), F.round(scalar.convert(x, "degrees", "radians"), 4).alias("radians"))


@query("select o_orderkey, (o_orderkey >> 8) & 255 as a, (o_orderkey >> 4) & 15 as b, o_orderkey & 15 as c, ((o_orderkey & 255) << 8) | ((o_orderkey >> 8) & 255) as swapped from orders")
def bits_unpack(spark, sf):
    k = F.col("o_orderkey")
    a, b, c = scalar.unpack_bits(k, [8, 4, 4])
    return _t(spark, sf, "orders").select("o_orderkey", a.alias("a"), b.alias("b"), c.alias("c"), scalar.reversed_bytes(k, 2).alias("swapped"))


@query("select v, count(*) as n from (select floor(embedding[1]/0.1)::bigint as v from embeddings) group by 1")
def voxel_counts(spark, sf):
    return _t(spark, sf, "embeddings").select(scalar.voxel(F.col("embedding")[0].cast("double"), 0.1).alias("v")).groupBy("v").agg(F.count("*").alias("n"))


@query("select event_id, round((value/50)*(value/50)*3 + 1, 1) as z from events where value between 0 and 50")
def lookup_interpolate(spark, sf):
    v = F.col("value")
    z = scalar.interpolate_grid(v, v, [[1, 1, 1], [1, 4, 7]], (0.0, 0.0), (50.0, 50.0))
    return _t(spark, sf, "events").filter(v.between(0, 50)).select("event_id", F.round(z, 1).alias("z"))


# --- sources and trees


@query("select n_nationkey, n_name, n_regionkey from nation")
def text_round_trip(spark, sf):
    lines = records.to_lines(_t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    return records.from_lines(lines, "n_nationkey,n_name,n_regionkey", "l,s[64],l").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", "n_regionkey")


@query("select o_orderkey, o_orderdate, o_orderstatus from orders")
def binary_round_trip(spark, sf):
    packed = records.pack(_t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), "l,t,s[4]")
    return records.unpack(packed, "l,t,s[4]", ["o_orderkey", "o_orderdate", "o_orderstatus"])


@query("select o_orderkey, o_totalprice, cast(o_totalprice as float) as price from orders")
def binary_floats(spark, sf):
    packed = records.pack(_t(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_totalprice").cast("float").alias("price")), "l,d,f")
    return records.unpack(packed, "l,d,f", ["o_orderkey", "o_totalprice", "price"])


@query("select 'INSERT INTO n (n_nationkey,n_name) VALUES (' || n_nationkey || ',''' || replace(n_name, '''', '''''') || ''');' as statement from nation")
def sql_inserts(spark, sf):
    return records.sql_inserts(_t(spark, sf, "nation").select("n_nationkey", "n_name"), "n")


@query("select event_id, unnest(json_keys(props)) as path, json_extract_string(props, '$.' || unnest(json_keys(props))) as value from events where props is not null")
def trees_flatten(spark, sf):
    return trees.flatten_json(_t(spark, sf, "events"), "props", ["event_id"])


@query("select n_nationkey, 'n_name' as path, n_name as value from nation union all select n_nationkey, 'n_regionkey', n_regionkey::varchar from nation")
def trees_from_columns(spark, sf):
    return trees.from_columns(_t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"])


@query("select path, case when r in (1,2) then 'b' else 'a' end as value, case when r in (1,2) then 1 else 0 end as source from (select r_name as path, r_regionkey as r from region)")
def trees_layered(spark, sf):
    r = _t(spark, sf, "region")
    a = r.select(F.col("r_name").alias("path"), F.lit("a").alias("value"))
    b = r.filter("r_regionkey in (1, 2)").select(F.col("r_name").alias("path"), F.lit("b").alias("value"))
    return trees.layered([a, b], [])


@query("select c_custkey as key, 0 as source from customer union all select s_suppkey, 1 from supplier")
def concatenate_sources(spark, sf):
    return rows.concatenated([_t(spark, sf, "customer").select(F.col("c_custkey").alias("key")), _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"))])


@query("select a, b, c from (values ('x'), ('y')) t(a), range(0, 4) u(b), (values (0.5::double), (1.5::double)) v(c)")
def trees_permute(spark, sf):
    return trees.permute(spark, {"a": F.array(F.lit("x"), F.lit("y")), "b": F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), "c": F.array(F.lit(0.5), F.lit(1.5))})


@query()
def sort_sliding_window(spark, sf):
    return rows.sliding_sort(_t(spark, sf, "events").select("event_type", "event_id", "value"), "value", 100, ["event_type"], ["event_id"])


@query()
def crc_of_names(spark, sf):
    name = F.col("n_name").cast("binary")
    return _t(spark, sf, "nation").select("n_nationkey", *(scalar.crc(name, w).alias(f"crc_{w}") for w in ("16", "ccitt", "xmodem", "32")))


# --- blocks, samples and generators


@query("""select o_orderkey, case when o_totalprice < 20000 or exists (select 1 from part where o_totalprice >= p_retailprice*100 and o_totalprice < p_retailprice*100 + 30) then 1 else 0 end as contained from orders""")
def interval_contain(spark, sf):
    spans = _spans(spark, sf).select("low", "high").unionByName(spark.sql("select cast(null as double) as low, 20000D as high"))
    return joins.contain(_t(spark, sf, "orders"), spans, "o_totalprice", "low", "high", 40.0).select("o_orderkey", "contained")


_DAYS = "select event_id, user_id, event_type, ts, dense_rank() over (order by ts::date) - 1 as block from events"


def _day_blocks(spark, sf):
    e = _t(spark, sf, "events")
    days = e.select(F.to_date("ts").alias("day")).distinct().withColumn("block", F.row_number().over(Window.orderBy("day")) - 1)
    return e.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day").select("event_id", "user_id", "event_type", "ts", "block")


@query(f"""with d as ({_DAYS}), l as (select event_type, block, max(event_id) as event_id from d group by all), b as (select distinct block from d)
select l.event_type, b.block, max_by(l.event_id, l.block) as event_id from b join l on l.block <= b.block group by all""")
def blocks_accumulate(spark, sf):
    days = _day_blocks(spark, sf).select("event_type", "block", "event_id")
    return blocks.accumulate(days, ["event_type"], [], ["event_id"]).select("event_type", F.col("block").cast("long").alias("block"), "event_id")


@query(f"with d as ({_DAYS}) select event_id, block, block + 10 as next_block from d where block = (select max(block) from d x where x.user_id = d.user_id)")
def update_last_block(spark, sf):
    last = blocks.last_block(_day_blocks(spark, sf), ["user_id"])
    return blocks.increment(last, 10).select("event_id", F.col("block").cast("long").alias("block"), F.col("next_block").cast("long").alias("next_block"))


@query(f"""with d as ({_DAYS}), u as (select event_id, user_id, dense_rank() over (order by block) as n from d where event_type = 'click'), v as (select event_id, user_id, dense_rank() over (order by block) as n from d where event_type = 'purchase')
select u.event_id, v.event_id as other_id from u join v using (n, user_id)""")
def join_block_wise(spark, sf):
    d = _day_blocks(spark, sf)
    clicks = d.filter("event_type = 'click'").select("event_id", "user_id", "block")
    bought = d.filter("event_type = 'purchase'").select(F.col("event_id").alias("other_id"), "user_id", "block")
    return joins.block_wise(clicks, bought, "block", [], ["user_id"]).select("event_id", "other_id")


@query("select event_id, user_id from (select *, row_number() over (partition by user_id order by md5('7:' || event_id), event_id) as n from events) where n <= 3")
def sample_per_block(spark, sf):
    return rows.sample_size(_t(spark, sf, "events"), 3, ["user_id"], ["event_id"], seed=7).select("event_id", "user_id")


@query("select event_id from events where ('0x' || substr(md5('0:' || event_id), 1, 8))::bigint < 0.25 * 4294967296")
def sample_ratio(spark, sf):
    return rows.sample_ratio(_t(spark, sf, "events"), 0.25, ["event_id"]).select("event_id")


@query("select event_id, case when event_type <> 'error' then event_type end as event_type from events")
def update_erase(spark, sf):
    return rows.erase(_t(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "error")


@query("""with m as (select o_orderkey as id, o_orderdate as t, 0 as source from orders union all select event_id, ts, 1 from events)
select id, source, round((epoch_us(t) - (select min(epoch_us(t)) from m)) / 1e6 / 2, 3) as after from m""")
def replay_merged(spark, sf):
    sides = [_t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("t")), _t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("t"))]
    return rows.replay(sides, "t", 2.0).select("id", "source", *_r("after"))


@query("select page_id, p::integer as part, v[1] as head, v[2 + 2*p] as a, v[3 + 2*p] as b from (select page_id, string_split(url, '/') as v, unnest(range(0, greatest(1, ceil((len(string_split(url, '/')) - 1) / 2.0))::bigint)) as p from pages)")
def shape_split(spark, sf):
    return rows.split_rows(_t(spark, sf, "pages").select("page_id", F.split("url", "/").alias("v")), F.col("v"), 2, ["head", "a", "b"], repeat=1).select("page_id", "part", "head", "a", "b")


@query("select page_id, array_to_string(list_resize(string_split(url, '/'), 6, '-'), '/') as line from pages")
def fields_make_fixed(spark, sf):
    return _t(spark, sf, "pages").select("page_id", scalar.make_fixed(F.col("url"), 6, "/", "-").alias("line"))


@query("select s_name, s_suppkey, s_name as s_name_1 from supplier")
def fields_shuffle(spark, sf):
    return fields.shuffle(_t(spark, sf, "supplier"), "s_name,s_suppkey,s_name")


@query("select 'src/' || p_size as root, 'a/' || 'b' as common from part group by p_size")
def strings_path_common(spark, sf):
    p = _t(spark, sf, "part").select("p_size", F.concat(F.lit("a/b/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path"))
    whole = p.unionByName(p.select("p_size", F.lit("a/b/x").alias("path")))
    return whole.groupBy(F.concat(F.lit("src/"), F.col("p_size").cast("string")).alias("root")).agg(scalar.path_common(F.col("path")).alias("common"))


@query("select 5 + (i // 4) * 3 as number from range(1000) t(i)")
def generate_line_numbers(spark, sf):
    return generate.line_numbers(spark, 1000, begin=5, step=3, block_size=4)


@query("select (i // 15) % 4 as i0, (i // 5) % 3 as i1, i % 5 as i2 from range(120) t(i)")
def generate_indices(spark, sf):
    return generate.indices(spark, [4, 3, 5], repeat=2)


_NESTED = """'{"user":{"id":' || user_id || ',"kinds":["' || event_type || '",null]},"v":[{"x":' || event_id || '}],"none":{}}'"""


def _nested(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.expr(_NESTED).alias("doc"))


@query("""with t as (select event_id, unnest([struct_pack(path := 'user/id', value := user_id::varchar), struct_pack(path := 'user/kinds[0]', value := event_type), struct_pack(path := 'user/kinds[1]', value := null::varchar), struct_pack(path := 'v[0]/x', value := event_id::varchar)]) as r from events)
select event_id, r.path as path, r.value as value from t""")
def trees_flatten_nested(spark, sf):
    return trees.flatten_tree(_nested(spark, sf), "doc", ["event_id"], depth=4)


@query("select event_id, 'user/kinds[0]' as path, event_type as value from events union all select event_id, 'user/kinds[1]', null from events")
def trees_get(spark, sf):
    return trees.under(trees.flatten_tree(_nested(spark, sf), "doc", ["event_id"], depth=4), "user/kinds")


def _order_sides(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_custkey", "o_orderstatus")
    return trees.from_columns(o, ["o_orderkey"]), trees.from_columns(o.select("o_orderkey", (F.col("price") / 2).alias("price"), F.lit(3).alias("o_custkey")), ["o_orderkey"])


@query("""select o_orderkey, 'price' as path, round(o_totalprice/2, 3) as value from orders union all select o_orderkey, 'o_custkey', round(o_custkey - 3.0, 3) from orders""")
def trees_calc(spark, sf):
    out = trees.calc_trees(*_order_sides(spark, sf), ["o_orderkey"], "sub", exclude=True)
    return out.select("o_orderkey", "path", F.round(F.col("value").cast("double"), 3).alias("value"))


@query("select o_orderkey, case when o_totalprice > o_totalprice/2 and o_custkey > 3 then 1 else 0 end as value from orders")
def trees_compare(spark, sf):
    return trees.calc_trees(*_order_sides(spark, sf), ["o_orderkey"], "gt")


@query("select o_orderkey from orders where abs(o_totalprice - 100000) <= 20000 and o_custkey > 5")
def eval_tolerance(spark, sf):
    o = _t(spark, sf, "orders")
    return o.filter(expressions.condition(o, expressions.tolerant("logical_and(o_totalprice == 100000 +/- 20000, o_custkey > 5)"))).select("o_orderkey")


@query("select s_suppkey, s_name as name, s_nationkey::varchar as nation from supplier")
def xml_get(spark, sf):
    doc = _t(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("<s><name>"), "s_name", F.lit("</name><of><nation>"), F.col("s_nationkey").cast("string"), F.lit("</nation></of></s>")).alias("doc"))
    return doc.select("s_suppkey", trees.xml_values(F.col("doc"), "s/name/text()")[0].alias("name"), trees.xml_values(F.col("doc"), "s/of/nation/text()")[0].alias("nation"))
