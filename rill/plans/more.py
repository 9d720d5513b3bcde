"""More registered queries: binary records, intervals, blocks, times, strings, checksums, grids, expressions, tree texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions, forms, scalar
from ..operators import blocks, calc, joins, rows, trees
from ..sources import generate, records
from .registry import _r, _t, query

# --- binary and text records


@query("select l_extendedprice, l_tax from lineitem")
def binary_doubles(spark, sf):
    d = _t(spark, sf, "lineitem").select("l_extendedprice", "l_tax")
    return records.unpack(records.pack(d, "2d"), "2d", d.columns)


_ALL = "b,ub,w,uw,i,ui,l,ul,f,d,c,t,tp,lt,s[16]"


@query("""select o_orderkey, (o_orderkey % 256 - 128)::tinyint as b, (o_orderkey % 256)::smallint as ub, (o_orderkey % 65536 - 32768)::smallint as w, (o_orderkey % 65536)::integer as uw, (-o_orderkey)::integer as i, 4294967295 - o_orderkey as ui,
-9223372036854775807 - 1 + o_orderkey as l, 18446744073709551615::decimal(20,0) - o_orderkey as ul, o_totalprice::float as f, -o_totalprice as d, substr(o_orderstatus, 1, 1) as c, o_orderdate as t, o_orderdate + interval 1 microsecond as tp, o_orderdate - interval 100 year as lt, o_orderpriority as s from orders""")
def binary_all_types(spark, sf):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    o = _t(spark, sf, "orders").select(
        (k % 256 - 128).cast("byte").alias("b"), (k % 256).cast("short").alias("ub"), (k % 65536 - 32768).cast("short").alias("w"), (k % 65536).cast("int").alias("uw"), (-k).cast("int").alias("i"), (F.lit(4294967295) - k).alias("ui"),
        (F.lit(-(1 << 63)) + k).alias("l"), (F.lit("18446744073709551615").cast("decimal(20,0)") - k).cast("decimal(20,0)").alias("ul"), F.col("o_totalprice").cast("float").alias("f"), (-F.col("o_totalprice")).alias("d"), F.substring("o_orderstatus", 1, 1).alias("c"),
        day.alias("t"), (day + F.expr("interval 1 microsecond")).alias("tp"), (day - F.expr("interval 100 year")).alias("lt"), F.col("o_orderpriority").alias("s"), k,
    )
    return records.unpack(records.pack(o, _ALL + ",l"), _ALL + ",l", o.columns)


@query("select o_orderkey || ',' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || ',' || o_orderstatus as value from orders")
def binary_to_text(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return records.binary_to_text(records.pack(o, "ul,t,s[4]"), "ul,t,s[4]")


@query("select o_orderkey, o_orderdate, o_orderstatus from orders")
def text_to_binary(spark, sf):
    lines = _t(spark, sf, "orders").select(F.concat_ws(",", F.col("o_orderkey").cast("string"), scalar.iso(F.col("o_orderdate")), "o_orderstatus").alias("value"))
    return records.unpack(records.text_to_binary(lines, "l,t,s[4]"), "l,t,s[4]", ["o_orderkey", "o_orderdate", "o_orderstatus"])


@query("select l_orderkey, l_quantity, l_extendedprice, l_returnflag from lineitem")
def text_lineitem(spark, sf):
    names = ["l_orderkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return records.from_lines(records.to_lines(_t(spark, sf, "lineitem").select(*names)), ",".join(names), "l,2d,s[8]")


@query("select n_nationkey, n_name as name, substr(n_name, 1, 3) as head from nation")
def text_fixed_columns(spark, sf):
    lines = _t(spark, sf, "nation").select("n_nationkey", F.concat(F.rpad("n_name", 20, " "), F.substring("n_name", 1, 3), F.lit("  ")).alias("value"))
    out = lines.withColumn("__z", F.struct(*(c for c in records.fixed_columns([20, 5], ["name", "head"]))))
    return out.select("n_nationkey", "__z.name", "__z.head")


@query("select octet_length(encode(n_name)) as length, n_name as value from nation")
def line_lengths(spark, sf):
    return records.line_lengths(_t(spark, sf, "nation").select(F.col("n_name").alias("value")))


@query("select o_orderkey, (((o_orderkey * 7) % 256 + 128) % 256 - 128)::tinyint as small, floor(o_totalprice)::integer as price from orders")
def cast_forced(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * 7).alias("small"), F.col("o_totalprice").alias("price"))
    return records.cast_records(o, "l,l,d", "l,b,i", force=True)


@query("select event_id, (select max(x) from (values (timestamp '2024-01-05'), (timestamp '2024-01-10 12:00:00'), (timestamp '2024-01-20')) v(x) where x <= ts) as file from events")
def split_by_times(spark, sf):
    import datetime

    times = [datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 20), datetime.datetime(2024, 1, 10, 12)]
    return generate.by_times(_t(spark, sf, "events").select("event_id", "ts"), "ts", times).select("event_id", "file")


@query("""with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts) as i from events),
f as (select event_id, user_id, i, ts as file from e where i = 1 union all
select e.event_id, e.user_id, e.i, case when e.ts > f.file + interval 2 day then e.ts else f.file end from f join e on e.user_id = f.user_id and e.i = f.i + 1) select event_id, file from f""")
def split_by_period(spark, sf):
    return generate.by_period(_t(spark, sf, "events").select("event_id", "user_id", "ts"), "ts", 2 * 86400.0, ["user_id"], ["ts"]).select("event_id", "file")


@query("""with o as (select *, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders), p as (select n_nationkey, n_nationkey / 25.0::double as ratio from nation)
select n_nationkey, o_orderkey from p join o on o.i = floor(p.ratio * o.n)""")
def seek_ratio(spark, sf):
    positions = _t(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") / 25).alias("ratio"))
    return generate.seek(positions, _t(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], ratio="ratio").select("n_nationkey", "record.o_orderkey")


@query("select event_id, row_number() over (order by ts, event_id) - 1 as number from events")
def generate_numbers(spark, sf):
    return generate.numbered(_t(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "number")


@query("with a as (select r_regionkey as key, (row_number() over (order by r_regionkey) - 1) // 2 as turn, 0 as source from region), b as (select n_nationkey, (row_number() over (order by n_nationkey) - 1) // 2, 1 from nation) select * from a union all select * from b")
def interleaved_sources(spark, sf):
    sides = [_t(spark, sf, "region").select(F.col("r_regionkey").alias("key")), _t(spark, sf, "nation").select(F.col("n_nationkey").alias("key"))]
    return rows.interleaved(sides, [["key"], ["key"]], block=2)


# --- selections and sorts


@query("select min(o_orderkey) as o_orderkey from orders where o_totalprice > 100000")
def select_first_match(spark, sf):
    return rows.first_match(_t(spark, sf, "orders"), [F.col("o_totalprice") > 100000], ["o_orderkey"]).select("o_orderkey")


@query("select o_orderkey from orders where regexp_full_match(o_orderpriority, '[12]-.*')")
def select_full_match(spark, sf):
    return rows.select_records(_t(spark, sf, "orders"), [rows.matches("o_orderpriority", "[12]-.*")]).select("o_orderkey")


@query("select event_id, case when value > 90 or value < 5 then 1 else 0 end as missing from events")
def select_nan(spark, sf):
    v = F.when(F.col("value") > 90, F.lit(float("nan"))).when(F.col("value") >= 5, F.col("value"))
    e = _t(spark, sf, "events").select("event_id", v.alias("value"))
    return rows.select_records(e, [rows.is_not_a_value("value", "double")], flag="missing").select("event_id", "missing")


@query("select event_id from (select *, row_number() over (partition by user_id order by ts) as n from events) where not floor(n*0.25+1e-9) > floor((n-1)*0.25+1e-9)")
def thin_inverted(spark, sf):
    return rows.thin(_t(spark, sf, "events"), 0.25, ["user_id"], ["ts"], invert=True).select("event_id")


@query("select event_id, row_number() over (partition by user_id order by event_type desc, ts) - 1 as place from events")
def sort_blocks(spark, sf):
    return rows.sort_records(_t(spark, sf, "events").select("event_id", "user_id", "event_type", "ts"), ["event_type"], ["ts"], ["user_id"], reverse=True, place="place").select("event_id", "place")


@query("select o_custkey, o_orderstatus, min(o_orderkey) as o_orderkey from orders group by all")
def sort_unique(spark, sf):
    return rows.sort_records(_t(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey"), ["o_orderstatus"], ["o_orderkey"], ["o_custkey"], unique=True)


@query("select event_id, (row_number() over (partition by user_id order by ts) - 1) // 7 as block from events")
def blocks_by_count(spark, sf):
    return blocks.group_by_count(_t(spark, sf, "events").select("event_id", "user_id", "ts"), 7, ["user_id"], ["ts"]).select("event_id", "block")


@query("""with c as (select event_id, user_id, ts, value between 20 and 80 as i, case when lag(value between 20 and 80) over w and not (value between 20 and 80) then 1 else 0 end as c from events window w as (partition by user_id order by ts)),
b as (select event_id, i, sum(c) over (partition by user_id order by ts)::bigint as block from c) select event_id, block from b where i""")
def blocks_by_range_discard(spark, sf):
    return blocks.group_by_range(_t(spark, sf, "events"), F.col("value"), 20, 80, ["user_id"], ["ts"], discard=True).select("event_id", "block")


@query("select a.n_nationkey // 5 as part, a.n_name as n_name_0, b.n_name as n_name_1, c.n_name as n_name_2 from nation a join nation b on b.n_nationkey = a.n_nationkey + 2 join nation c on c.n_nationkey = a.n_nationkey + 4 where a.n_nationkey % 5 = 0")
def shape_tumbling(spark, sf):
    return rows.concatenate_blocks(_t(spark, sf, "nation"), "n_name", 3, [], ["n_nationkey"], step=2)


@query("""with e as (select event_id, row_number() over (partition by user_id order by ts) - 1 as i, count(*) over (partition by user_id) as n from events)
select event_id, unnest(generate_series(i, least(i + 2, n - 1))) as window from e""")
def shape_sliding_incremental(spark, sf):
    return rows.sliding_rows(_t(spark, sf, "events").select("event_id", "user_id", "ts"), 3, 1, ["user_id"], ["ts"], incremental=True).select("event_id", "window")


# --- statistics and updates, null groups among them


@query("select event_type, min(ts) as ts_min, max(ts) as ts_max, make_timestamp(round(avg(epoch_us(ts)))::bigint) as ts_mean, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as ts_diameter, count(ts) as ts_size from events group by 1")
def calc_times(spark, sf):
    return calc.typed_calc(_t(spark, sf, "events"), ["min", "max", "mean", "diameter", "size"], ["ts"], ["event_type"])


@query("with o as (select o_orderkey, case when o_orderstatus <> 'F' then o_orderstatus end as s, o_totalprice from orders) select o_orderkey, s, max(o_totalprice) over (partition by s) as o_totalprice_max from o")
def calc_append_nulls(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("s"), "o_totalprice")
    return calc.calc_append(o, ["max"], ["o_totalprice"], ["s"]).drop("o_totalprice")


@query("""with o as (select o_orderkey, case when o_orderstatus <> 'F' then o_orderstatus end as s, o_totalprice from orders), e as (select *, min(o_totalprice) over (partition by s) as mn, max(o_totalprice) over (partition by s) as mx from o)
select o_orderkey, s, case when o_totalprice = mn then 'min' else 'max' end as side from e where o_totalprice in (mn, mx)""")
def sort_min_max_nulls(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("s"), "o_totalprice")
    return rows.extremes(o, "o_totalprice", ["s"]).drop("o_totalprice")


@query("""with recursive e as (select event_id, user_id, value, row_number() over (partition by user_id order by ts) as i from events),
f as (select event_id, user_id, i, value as a from e where i = 1 union all
select e.event_id, e.user_id, e.i, case when e.i <= 3 then f.a + (e.value - f.a) / e.i else f.a + (e.value - f.a) * 0.25::double end from f join e on e.user_id = f.user_id and e.i = f.i + 1) select event_id, round(a, 9) as average from f""")
def calc_moving_average(spark, sf):
    return calc.moving_average(_t(spark, sf, "events").select("event_id", "user_id", "ts", "value"), "value", 0.25, ["user_id"], ["ts"], spread=3).select("event_id", *_r("average", n=9))


@query("""with g as (select user_id, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts)) / 1e6 as g from events)
select user_id, count(g) as intervals, round(avg(g), 3) as mean, min(g) as least, max(g) as greatest, round(stddev_pop(g), 3) as deviation from g group by 1""")
def calc_interval_stats(spark, sf):
    out = calc.interval_stats(_t(spark, sf, "events"), "ts", ["user_id"], ["ts"])
    return out.select("user_id", "intervals", F.round("mean", 3).alias("mean"), "least", "greatest", F.round("deviation", 3).alias("deviation"))


@query("with g as (select event_type, min(ts) as f, count(*) as count from events group by 1) select event_type, count, row_number() over (order by f) - 1 as id from g")
def enumerate_by_time(spark, sf):
    return rows.enumerate_keys(_t(spark, sf, "events"), ["event_type"], ["ts"])


@query("with g as (select user_id, row_number() over (order by min(event_id)) - 1 as id from events group by 1) select event_id, id from events join g using (user_id)")
def enumerate_rows(spark, sf):
    return rows.enumerate_rows(_t(spark, sf, "events").select("event_id", "user_id"), ["user_id"], ["event_id"]).select("event_id", "id")


@query("""with v as (select event_id, user_id, ts, case when value > 50 then event_type end as v from events),
m as (select *, count(v) over (partition by user_id order by ts) as g from v) select event_id, nullif(max(v) over (partition by user_id, g), 'error') as value from m""")
def update_running_erase(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", F.when(F.col("value") > 50, F.col("event_type")).alias("value"))
    return rows.running_update(e, ["value"], ["user_id"], ["ts"], erase="error").select("event_id", "value")


@query("""with v as (select conv_id, turn, turn // 2 as block, case when turn % 3 = 0 then role end as role from conversations), m as (select *, count(role) over (partition by conv_id order by turn) as g, max(block) over (partition by conv_id) as top from v)
select conv_id, turn, block, r as role from (select *, max(role) over (partition by conv_id, g) as r from m) where block = top""")
def update_running_last_block(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 2).cast("long").alias("block"), F.when(F.col("turn") % 3 == 0, F.col("role")).alias("role"))
    return rows.running_last_block(c, ["role"], ["conv_id"], "block", ["turn"])


@query("select n_nationkey, case when n_nationkey = 7 then 'SEVEN' else n_name end as n_name from nation")
def update_line(spark, sf):
    return rows.update_line(_t(spark, sf, "nation").select("n_nationkey", "n_name"), {"n_nationkey": 7, "n_name": "SEVEN"}, ["n_nationkey"])


# --- joins


@query("select n_name, r_name from nation cross join region")
def join_every_pair(spark, sf):
    return joins.every_pair(_t(spark, sf, "nation").select("n_name"), _t(spark, sf, "region").select("r_name"))


@query("select s_suppkey, c_custkey from supplier, customer where sqrt((s_acctbal - c_acctbal)**2 + (s_nationkey - c_nationkey)**2) <= 25")
def join_radius_two_dimensions(spark, sf):
    s, c = _t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), _t(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return joins.radius_join(s, c, ["s_acctbal", "s_nationkey"], ["c_acctbal", "c_nationkey"], 25.0).select("s_suppkey", "c_custkey")


def _grid_sides(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    kinds = "event_type = 'purchase'"
    return e.filter(f"not {kinds}").select("event_id", (F.col("day") + F.expr("interval 12 hour")).alias("t")), e.filter(kinds).groupBy("day").agg(F.min("event_id").alias("bound_id")).withColumnRenamed("day", "bound_t")


# every record stands midway between two days: all ties, where both have a bound
@query("""with b as (select date_trunc('day', ts) as t, min(event_id) as bound_id from events where event_type = 'purchase' group by 1), a as (select event_id, date_trunc('day', ts) + interval 12 hour as t from events where event_type <> 'purchase'),
lo as (select a.event_id, b.bound_id, epoch_us(a.t) - epoch_us(b.t) as d from a asof join b on a.t >= b.t), hi as (select a.event_id, b.bound_id, epoch_us(b.t) - epoch_us(a.t) as d from a asof join b on a.t < b.t)
select a.event_id, case when hi.bound_id is null or lo.d < hi.d then lo.bound_id else hi.bound_id end as bound_id from a left join lo using (event_id) left join hi using (event_id) where lo.bound_id is not null or hi.bound_id is not null""")
def time_join_nearest_ties(spark, sf):
    a, b = _grid_sides(spark, sf)
    return joins.time_join(a, b, "t", "bound_t", [], "nearest").select("event_id", "bound.bound_id")


@query("select a.event_id, (epoch_us(a.ts) - epoch_us(b.ts)) / 1e6 as seconds from (select * from events where event_type <> 'purchase') a asof join (select * from events where event_type = 'purchase') b on a.user_id = b.user_id and a.ts >= b.ts")
def time_join_difference(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    a, b = e.filter("event_type <> 'purchase'"), e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bound_ts"))
    met = joins.time_join(a, b, "ts", "bound_ts", ["user_id"])
    return met.select("event_id", joins.time_difference(F.col("ts"), F.col("bound.bound_ts")).alias("seconds"))


_PIECES = """with s as (select user_id, event_id, epoch_us(ts) // 1000000 as f, epoch_us(ts) // 1000000 + 86400 as t from events), p as (select distinct user_id, x from (select user_id, f as x from s union all select user_id, t from s)),
g as (select user_id, x, lead(x) over (partition by user_id order by x) as y from p), r as (select s.user_id, g.x as "from", g.y as "to", s.event_id, count(*) over (partition by s.user_id, g.x) as overlap from s join g on s.user_id = g.user_id and s.f <= g.x and g.x < s.t)
select * from r"""


def _event_days(spark, sf):
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    return _t(spark, sf, "events").select("user_id", "event_id", at.alias("low"), (at + 86400).alias("high"))


@query(_PIECES)
def interval_pieces(spark, sf):
    return joins.split_intervals(_event_days(spark, sf), "low", "high", ["user_id"])


@query(_PIECES + " where overlap between 2 and 3")
def interval_pieces_overlap(spark, sf):
    return joins.split_intervals(_event_days(spark, sf), "low", "high", ["user_id"], least=2, most=3)


_SPANS = "select p_retailprice*100 as low, p_retailprice*100 + case when p_partkey % 50 = 0 then 3000 else 30 end as high from part union all select null, 15000 union all select 400000, null"


def _mixed_spans(spark, sf):
    p = F.col("p_retailprice") * 100
    spans = _t(spark, sf, "part").select(p.alias("low"), (p + F.when(F.col("p_partkey") % 50 == 0, 3000.0).otherwise(30.0)).alias("high"))
    return spans.unionByName(spark.sql("select cast(null as double) as low, 15000D as high union all select 400000D, null"))


@query(f"with s as ({_SPANS}) select o_orderkey, low, high from orders, s where (low is null or o_totalprice >= low) and (high is null or o_totalprice < high)")
def interval_join_open(spark, sf):
    return joins.interval_join(_t(spark, sf, "orders"), _mixed_spans(spark, sf), "o_totalprice", "low", "high", 40.0).select("o_orderkey", "low", "high")


@query(f"with s as ({_SPANS}) select o_orderkey from orders where not exists (select 1 from s where (low is null or o_totalprice >= low) and (high is null or o_totalprice < high))")
def interval_not_matching(spark, sf):
    return joins.interval_join(_t(spark, sf, "orders"), _mixed_spans(spark, sf), "o_totalprice", "low", "high", 40.0, how="left_anti").select("o_orderkey")


# --- strings and times


@query("select page_id, 'p:' || url || ':s' as url from pages")
def strings_affixes(spark, sf):
    return _t(spark, sf, "pages").select("page_id", scalar.with_affixes(F.col("url"), "p:", ":s").alias("url"))


@query("select page_id, array_to_string(string_split(url, '/')[4:], '/') as base, array_to_string(string_split(url, '/')[1:3], '/') as dir from pages where len(string_split(url, '/')) > 3")
def strings_path_heads(spark, sf):
    p = F.col("url")
    return _t(spark, sf, "pages").filter(F.size(F.split("url", "/")) > 3).select("page_id", scalar.path_basename(p, head=3).alias("base"), scalar.path_dirname(p, head=3).alias("dir"))


@query("select n_nationkey, '/a/' || n_name as path from nation")
def strings_path_normal(spark, sf):
    messy = F.concat(F.lit("/a//x/../b/.."), F.lit("/./"), "n_name", F.lit("/"))
    return _t(spark, sf, "nation").select("n_nationkey", scalar.path_normal(messy).alias("path"))


@query("select o_orderkey, '\"' || o_orderpriority || '\"' as priority, o_orderkey::varchar as number, o_orderpriority as back from orders")
def strings_quotes(spark, sf):
    p = F.col("o_orderpriority")
    return _t(spark, sf, "orders").select("o_orderkey", scalar.quoted(p).alias("priority"), scalar.quoted(F.col("o_orderkey").cast("string")).alias("number"), scalar.unquoted(scalar.quoted(p, force=True)).alias("back"))


@query("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as xsd, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as sql, strftime(ts, '%Y%m%dT%H%M%S.%f') as iso, epoch_us(ts)::varchar as micros, strftime(ts, '%d/%m/%Y') as own,
strftime(ts + interval 37 second, '%Y%m%dT%H%M%S.%f') as tai from events where epoch_us(ts) % 1000000 <> 0""")
def time_texts(spark, sf):
    t = F.col("ts")
    kinds = {"xsd": "xsd", "sql": "sql", "iso": "iso-always-with-fractions", "micros": "microseconds", "own": "format;dd/MM/yyyy", "tai": "tai"}
    return _t(spark, sf, "events").filter(F.unix_micros(t.cast("timestamp")) % 1000000 != 0).select("event_id", *(scalar.format_time(t, k).alias(n) for n, k in kinds.items()))


@query("select event_id, ts as guessed, ts as back, ts - interval 11 hour as east, ts + interval 90 minute as west from events")
def time_xsd(spark, sf):
    t = F.col("ts")
    text = scalar.format_time(t, "xsd")
    with_offset = lambda o: scalar.parse_time(F.concat(text, F.lit(o)), "xsd")
    return _t(spark, sf, "events").select("event_id", scalar.parse_time(F.concat(text, F.lit("Z"))).alias("guessed"), scalar.parse_time(scalar.format_time(t, "tai"), "tai").alias("back"), with_offset("+1100").alias("east"), with_offset("-01:30").alias("west"))


@query("select event_id, ts as a, ts as b from events")
def time_sql(spark, sf):
    t = F.col("ts")
    return _t(spark, sf, "events").select("event_id", scalar.parse_time(scalar.format_time(t, "sql"), "sql").alias("a"), scalar.parse_time(scalar.format_time(t, "seconds"), "seconds").alias("b"))


# --- numbers, checksums, grids


@query("select p_partkey, round(p_size * case p_partkey % 3 when 0 then 0.3048::double when 1 then 1852 else null end, 4) as metres from part")
def units_from_column(spark, sf):
    unit = F.when(F.col("p_partkey") % 3 == 0, "feet").when(F.col("p_partkey") % 3 == 1, "nautical-miles").otherwise("pounds")
    return _t(spark, sf, "part").select("p_partkey", F.round(scalar.convert_from(F.col("p_size"), unit, "metres"), 4).alias("metres"))


@query("select event_id, round(value * 2 + 1, 6) as scaled, round(value - 30 * floor(value / 30) , 6) as cycle from events")
def numbers_cyclic(spark, sf):
    v = F.col("value")
    return _t(spark, sf, "events").select("event_id", F.round(scalar.linear(v, 2, 1), 6).alias("scaled"), F.round(scalar.cyclic(v, 0, 30), 6).alias("cycle"))


_CRC = "list_reduce(list_prepend(65535::bigint, flatten(list_transform(range(1, len({x}) + 1), lambda i: [ord({x}[i])::bigint * 256, 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor((xor(a, x) * 2) % 65536, (xor(a, x) // 32768) * 4129))"


@query(f"select n_nationkey, n_name || ',' || {_CRC.format(x='n_name')} as line, true as holds, n_name as back from nation")
def crc_lines(spark, sf):
    line = scalar.crc_wrapped(F.col("n_name"))
    return _t(spark, sf, "nation").select("n_nationkey", line.alias("line"), scalar.crc_holds(line).alias("holds"), scalar.crc_checked(line).alias("back"))


@query("select event_id, round(1 + 2*(value/10) + 3*(value/20) + 4*(value/50), 4) as a, round(7 - value/20, 4) as b from events where value <= 100")
def lookup_three_dimensions(spark, sf):
    v = F.col("value")
    grid = [[1 + 2 * x + 3 * y + 4 * z, 7 - y] for x in range(11) for y in range(6) for z in range(3)]
    z = scalar.interpolate([v, v, v], [[float(n) for n in g] for g in grid], (11, 6, 3), (0.0, 0.0, 0.0), (10.0, 20.0, 50.0))
    return _t(spark, sf, "events").filter("value <= 100").select("event_id", F.round(z[0], 4).alias("a"), F.round(z[1], 4).alias("b"))


# --- expressions


@query("select event_id, sum(value) over (partition by user_id order by ts rows unbounded preceding)::decimal(18,4)::double as total, row_number() over (partition by user_id order by ts) as n from events")
def eval_running(spark, sf):
    e = _t(spark, sf, "events").select("event_id", "user_id", "ts", "value")
    return expressions.evaluate_running(e, "total=total+value;n=n+1", {"total": 0.0, "n": 0}, ["user_id"], ["ts"]).select("event_id", F.round("total", 4).alias("total"), "n")


@query("select event_id, round(case when value < 50 then 0 when value = 50 then 0.5::double else 1 end + atan2(value, 2.0::double), 6) as z, round(sqrt(value*value + 9), 6) as h from events")
def eval_batches(spark, sf):
    out = expressions.evaluate_batches(_t(spark, sf, "events").select("event_id", "value"), "z=heaviside(value-50,0.5)+arctan2(value,2);h=hypot(value,3)")
    return out.select("event_id", F.round("z", 6).alias("z"), F.round("h", 6).alias("h"))


@query("select event_id, upper(event_type) as u, round(log10(value + 1), 6) as g, round(degrees(atan(value)), 6) as d, least(value, 40.0::double) as m from events")
def eval_functions(spark, sf):
    out = expressions.evaluate(_t(spark, sf, "events").select("event_id", "event_type", "value"), "u=char.upper(event_type);g=log10(value+1);d=degrees(arctan(value));m=min((value,40.0),axis=0)")
    return out.select("event_id", "u", F.round("g", 6).alias("g"), F.round("d", 6).alias("d"), "m")


@query("select event_id from (select *, max(case when value > 95 then 1 else 0 end) over (partition by user_id order by ts rows between unbounded preceding and current row) as d from events) where d = 0")
def eval_until(spark, sf):
    return expressions.until(_t(spark, sf, "events"), "value > 95", ["user_id"], ["ts"]).select("event_id")


# --- property trees


def _nation_leaves(spark, sf):
    n = _t(spark, sf, "nation")
    return trees.from_columns(n.select("n_nationkey", F.col("n_name").alias("of/name"), F.col("n_regionkey").alias("of/region")), ["n_nationkey"])


@query("select n_nationkey, 'of/name' as path, n_name as value from nation union all select n_nationkey, 'of/region', n_regionkey::varchar from nation")
def trees_convert(spark, sf):
    leaves = _nation_leaves(spark, sf)
    for kind in ("ini", "info", "xml", "json", "path-value"):
        leaves = forms.parse_trees(forms.render_trees(leaves, ["n_nationkey"], kind), "document", ["n_nationkey"], kind).drop("leaf")
    return leaves


@query("""select n_nationkey, '[of]' || chr(10) || 'name=' || n_name || chr(10) || 'region=' || n_regionkey as ini, '{"of":{"name":"' || n_name || '","region":"' || n_regionkey || '"}}' as json, '<of><name>' || n_name || '</name><region>' || n_regionkey || '</region></of>' as xml from nation""")
def trees_render(spark, sf):
    leaves = _nation_leaves(spark, sf)
    out = None
    for kind in ("ini", "json", "xml"):
        one = forms.render_trees(leaves, ["n_nationkey"], kind).withColumnRenamed("document", kind)
        out = one if out is None else out.join(one, "n_nationkey")
    return out


@query("select o_orderkey, o_orderstatus as status, o_custkey::varchar as customer from orders")
def trees_to_columns(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), "o_totalprice")
    return trees.to_columns(trees.from_columns(o, ["o_orderkey"]), ["o_orderkey"], ["status", "customer"])


@query("select conv_id, turn as index, role, turn::varchar as n from conversations")
def trees_indexed(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("turn").alias("n"))
    paths = trees.from_columns(c, ["conv_id", "turn"], "talk/", index="turn").drop("turn")
    return trees.indexed_to_columns(paths, ["conv_id"], ["role", "n"], "talk/")


@query("select conv_id, row_number() over (partition by conv_id order by turn) - 1 as record, role, turn::varchar as n from conversations")
def trees_stream(spark, sf):
    c = _t(spark, sf, "conversations")
    paths = c.select("conv_id", (F.col("turn") * 2).alias("at"), F.lit("role").alias("path"), F.col("role").alias("value")).unionByName(c.select("conv_id", (F.col("turn") * 2 + 1).alias("at"), F.lit("n").alias("path"), F.col("turn").cast("string").alias("value")))
    return trees.stream_to_columns(paths, ["conv_id"], ["role", "n"], ["at"])
