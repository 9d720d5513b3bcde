"""Golden cases and edge rows of binary records, joins, folds, tree texts, checksums and streams."""

import datetime
import decimal
import random
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rill.functions import expressions, forms, scalar
from rill.operators import blocks, calc, joins, rows, trees
from rill.sources import generate, records
from rill.streaming import latest

T0 = datetime.datetime(2020, 1, 1, 0, 0, 10)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_all_binary_types(spark):
    spec, names = "b,ub,w,uw,i,ui,l,ul,f,d,c,t,tp,lt,s[4]", [f"x{k}" for k in range(15)]
    t = datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)
    whole = [(-128, 255, -5, 65535, -7, 2**32 - 1, -(2**63), decimal.Decimal(2**64 - 1), 1.5, -2.25, "z", t, t, t, "ab"), (127, 0, 0, 0, 0, 0, 0, decimal.Decimal(0), float("inf"), 0.0, "", None, records.INFINITE[(1 << 63) - 1], datetime.datetime(1960, 1, 1, 0, 0, 0, 5), "é é"[:2])]
    df = spark.createDataFrame(whole, records.record_schema(spec, names)).coalesce(1)
    packed = records.pack(df, spec)
    assert [len(r.record) for r in packed.collect()] == [records.format_size(spec)] * 2
    assert [tuple(r) for r in records.unpack(packed, spec, names).collect()] == whole
    raw = bytes(records.pack(df.select("x11", "x12"), "t,tp").collect()[1].record)
    assert np.frombuffer(raw, dtype="<i8").tolist() == [-(2**63), 2**63 - 1]


def test_binary_errors_and_nulls(spark):
    one = lambda value, kind: spark.createDataFrame([(value,)], f"x {kind}")
    for value, kind, spec in (("abcdef", "string", "s[4]"), (300, "int", "ub"), (-1, "long", "ul"), ("ab", "string", "c")):
        with pytest.raises(Exception, match="longer|fit|range|bounds|convert"):
            records.pack(one(value, kind), spec).collect()
    with pytest.raises(Exception, match="bytes"):
        records.unpack(one(bytearray(b"12345"), "binary"), "i", ["x"], record="x").collect()
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, s string").coalesce(1)
    back = records.unpack(records.pack(df, "i,s[2]"), "i,s[2]", ["x", "s"]).collect()
    assert [tuple(r) for r in back] == [(1, "a"), (None, None), (None, None)]


def test_binary_files(spark, tmp_path):
    df = spark.range(0, 100_000, 1, 3).selectExpr("cast(id as double) a", "cast(id as double) / 3 b")
    records.write_binary(df, f"{tmp_path}/d", "2d")
    back = records.read_binary(spark, f"{tmp_path}/d", "2d", "a,b", split=200_000)
    assert back.rdd.getNumPartitions() >= 8 and back.count() == 100_000 and back.exceptAll(df).count() == 0
    np.arange(10, dtype="<i4").tofile(f"{tmp_path}/ten.bin")
    assert [r.x for r in records.read_binary(spark, f"{tmp_path}/ten.bin", "i", "x", skip=3, count=4).collect()] == [3, 4, 5, 6]
    (tmp_path / "odd.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole records"):
        records.read_binary(spark, f"{tmp_path}/odd.bin", "i", "x").count()


def test_text_and_binary(spark):
    lines = spark.createDataFrame([("1,2.123456789,abc,20200101T000000.5",), ("3,,x,",), ("4,1,y,+infinity",)], "value string").coalesce(1)
    packed = records.text_to_binary(lines, "ui,d,s[3],t")
    assert [r.value for r in records.binary_to_text(packed, "ui,d,s[3],t", precision=6).collect()][:2] == ["1,2.12346,abc,20200101T000000.500000", "3,0,x,not-a-date-time"]
    assert records.guess_format("20200101T000000,1,2.5,x,1e5") == "t,l,d,s[1024],d"
    with pytest.raises(ValueError, match="doesn't fit"):
        records.cast_records(spark.createDataFrame([(1.0,)], "x double"), "d", "f")
    with pytest.raises(ValueError, match="time"):
        records.cast_records(spark.createDataFrame([(1,)], "x int"), "i", "t")
    assert [r.x for r in records.cast_records(spark.createDataFrame([(300.7,), (-1.2,)], "x double").coalesce(1), "d", "ub", force=True).collect()] == [44, 255]
    raw = spark.createDataFrame([(bytearray(b"\0abc" * 50),)], "record binary")
    assert {r.distance: r.n for r in records.layout_distances(raw, 16).collect()} == {4: 196}
    assert tuples(records.from_columns(spark.createDataFrame([("ab  cde ",)], "value string"), [4, 4], ["x", "y"])) == [("ab", "cde")]


def test_repeats_until_the_next_record(spark):
    df = spark.createDataFrame([(T0, "a"), (T0 + datetime.timedelta(seconds=10), "b")], "t timestamp_ntz, v string")
    shown = lambda **k: [(r.v, (r.at - T0).total_seconds(), r.repeated) for r in rows.fill_holes(df, "t", 3.0, [], ["t"], **k).orderBy("at", F.desc("repeated")).collect()]
    middle = [("a", 0, 0), ("a", 3, 1), ("a", 6, 1), ("a", 9, 1), ("a", 10, 1), ("b", 10, 0)]
    assert shown() == middle
    before = [("a", -10, 1), ("a", -7, 1), ("a", -4, 1), ("a", -1, 1), ("a", 0, 1)]
    after = [("b", 13, 1), ("b", 16, 1), ("b", 19, 1), ("b", 20, 1)]
    assert shown(since=T0 - datetime.timedelta(seconds=10), until=T0 + datetime.timedelta(seconds=20)) == before + middle + after
    assert len(rows.fill_holes(df, "t", 11.0, [], ["t"]).collect()) == 2


def test_pieces_of_intervals(spark):
    df = spark.createDataFrame([(1, 5, "A"), (2, 4, "B"), (3, 6, "C"), (3, 6, "C"), (7, 7, "D"), (None, 2, "E")], "low int, high int, payload string")
    want = [(1, 2, "A"), (2, 3, "A"), (2, 3, "B"), (3, 4, "A"), (3, 4, "B"), (3, 4, "C"), (4, 5, "A"), (4, 5, "C"), (5, 6, "C")]
    got = joins.split_intervals(df, "low", "high", [])
    assert sorted((r["from"], r.to, r.payload) for r in got.collect()) == want
    assert sorted((r["from"], r.payload) for r in joins.split_intervals(df, "low", "high", [], least=3).collect()) == [(3, "A"), (3, "B"), (3, "C")]
    limited = joins.split_intervals(df, "low", "high", [], limits=(0, 9))
    assert (0, 1, "E") in {(r["from"], r.to, r.payload) for r in limited.collect()}
    keyed = df.withColumn("g", F.lit(None).cast("int"))
    assert joins.split_intervals(keyed, "low", "high", ["g"]).count() == 9


def test_as_of_ties_and_equal_bounds(spark):
    a = spark.createDataFrame([(k, 2 * k + 1) for k in range(200)] + [(900, -5), (901, 10**6)], "id int, t long").withColumn("t", F.timestamp_micros(F.col("t") * 500_001).cast("timestamp_ntz"))
    b = spark.createDataFrame([(2 * k, k) for k in range(201)], "t long, n int").withColumn("t", F.timestamp_micros(F.col("t") * 500_001).cast("timestamp_ntz"))
    got = {r.id: r.n for r in joins.time_join(a, b.withColumnRenamed("t", "bt"), "t", "bt", [], "nearest").select("id", "bound.n").collect()}
    assert got == {**{k: k + 1 for k in range(200)}, 900: 0, 901: 200}
    ends = spark.createDataFrame([(1, "x"), (1, "y"), (3, "u"), (3, "v")], "bt int, n string")
    mid = spark.createDataFrame([(1,), (2,)], "t int")
    lower, upper = ({r.t: r.n for r in joins.time_join(mid, ends.repartition(3), "t", "bt", [], how, bound_order=["n"]).select("t", "bound.n").collect()} for how in ("lower", "upper"))
    assert lower == {1: "y", 2: "y"} and upper == {1: "u", 2: "u"}


def test_upper_costs_what_lower_does(spark):
    n = 60_000
    a, b = spark.range(n).selectExpr("0 as g", "id * 2 as t"), spark.range(n).selectExpr("0 as g", "id * 2 + 1 as bt")
    took = {}
    for how in ("lower", "lower", "upper"):
        began = time.perf_counter()
        assert joins.time_join(a, b, "t", "bt", ["g"], how).count() == n - (how == "lower")
        took[how] = time.perf_counter() - began
    assert took["upper"] < 2 * took["lower"] + 3


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 7), (3, None, 9)], "id int, g string, v int")
    assert calc.calc_append(df, ["max"], ["v"], ["g"]).count() == 3
    assert tuples(rows.extremes(df, "v", ["g"]).select("id", "side")) == [(1, "min"), (2, "min"), (3, "max")]
    assert tuples(joins.first_matching(df.select("g", "id"), df.select("g", "v"), ["g"], ["id"], ["v"]).select("id", "v")) == [(1, 5), (2, 7)]
    assert blocks.last_block(df.withColumnRenamed("v", "block"), ["g"]).count() == 2
    assert {r.id: r.n for r in rows.enumerate_rows(df, ["g"], ["id"], "n").collect()} == {1: 0, 2: 1, 3: 1}


def test_queue_match(spark):
    a, b = spark.createDataFrame([(0, 1.0, "a"), (0, 5.0, "b"), (0, 9.0, "c")], "g int, t double, x string"), spark.createDataFrame([(0, 1.5, "p"), (0, 3.0, "q"), (0, 9.0, "r")], "g int, u double, y string")
    at = lambda d, c: d.withColumn(c, F.timestamp_micros((F.col(c) * 1e6).cast("long")).cast("timestamp_ntz"))
    got = joins.queue_match(at(a, "t"), at(b, "u"), "t", "u", ["g"], 1.0)
    assert tuples(got.select("x", "match.y")) == [("a", "p"), ("c", "r")]


def test_joins_that_refuse(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="more than one"):
        joins.unique_strict(df, ["k"]).collect()
    assert joins.unique_strict(df.distinct(), ["k"]).count() == 2
    with pytest.raises(ValueError, match="more than"):
        joins.every_pair(df, df, most=2)


def test_long_and_open_intervals(spark):
    draw = random.Random(2)
    spans = [(x := draw.uniform(0, 1000), x + draw.choice([0.5, 3, 40, 5000, 0])) for _ in range(150)] + [(None, 20.0), (990.0, None)]
    points = [draw.uniform(-10, 1100) for _ in range(300)]
    df, i = spark.createDataFrame([(p,) for p in points], "x double"), spark.createDataFrame(spans, "low double, high double")
    met = lambda p, s: (s[0] is None or s[0] <= p) and (s[1] is None or p < s[1])
    want = sorted((p, *s) for p in points for s in spans if met(p, s))
    assert tuples(joins.interval_join(df, i, "x", "low", "high", 1.0)) == sorted(want, key=str)
    inside = sorted(p for p in points if any(met(p, s) for s in spans))
    assert sorted(r.x for r in joins.interval_join(df, i, "x", "low", "high", 1.0, "left_semi").collect()) == inside
    assert joins.interval_join(df, i, "x", "low", "high", 1.0, "left_anti").count() == 300 - len(inside)


def test_blocks_of_times_and_averages(spark):
    df = spark.createDataFrame([(T0 + datetime.timedelta(seconds=s), float(s)) for s in (0, 1, 4, 5, 9)], "t timestamp_ntz, x double")
    assert [r.block for r in blocks.group_by_span(df, "t", 3.0, [], ["t"]).orderBy("t").collect()] == [0, 0, 1, 1, 2]
    assert [r.average for r in calc.moving_average(df, "x", 0.5, [], ["t"], spread=2).orderBy("t").collect()] == [0, 0.5, 2.25, 3.625, 6.3125]
    with pytest.raises(ValueError, match="not defined"):
        calc.typed_calc(df, ["sum"], ["t"], [])
    with pytest.raises(Exception, match="not complete"):
        rows.concatenate_blocks(df, "x", 2, [], ["t"]).collect()
    assert [r.file for r in generate.by_period(df, "t", 4.0, [], ["t"]).orderBy("t").collect()] == [T0] * 3 + [T0 + datetime.timedelta(seconds=5)] * 2


def test_mean_of_times_as_sql(spark):
    draw = random.Random(5)
    rows_ = [(g, T0 + datetime.timedelta(microseconds=draw.randrange(30 * 86400 * 10**6))) for g in range(60) for _ in range(1 + 7 * g)]
    rows_ += [(100 + k, T0 + datetime.timedelta(microseconds=m)) for k in range(4) for m in (0, 0, 1 + k, k)] + [(200, None), (201, T0), (201, None)]
    got = calc.typed_calc(spark.createDataFrame(rows_, "g int, t timestamp_ntz"), ["mean", "size"], ["t"], ["g"])
    x = pd.DataFrame(rows_, columns=["g", "t"])
    c = duckdb.connect()
    c.register("x", x)
    want = c.execute("with y as (select g::int as g, t::timestamp as t from x) select g, make_timestamp(round(avg(epoch_us(t)))::bigint), count(t) from y group by 1 order by 1").fetchall()
    assert [tuple(r) for r in got.orderBy("g").collect()] == want


def test_a_parsed_text_is_evaluated_once(spark):
    df = spark.createDataFrame([("2020-01-01 10:00:00.1234567Z",), ("2020-01-01 12:00:00+0130",), ("2020-01-01 10:00:00.5-00:30",), ("2020-01-01 10:00:00.",), ("2020-02-30 10:00:00",), (None,)], "x string")
    for kind in ("sql", "xsd", "guess", "tai"):
        plan = df.select(scalar.parse_time(F.reverse(F.reverse(F.lower("x"))), kind).alias("t"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("lower(") == 1
    day = datetime.datetime(2020, 1, 1, 10)
    assert [r.t for r in df.select(scalar.parse_time(F.col("x"), "sql").alias("t")).collect()] == [day.replace(microsecond=123456), day.replace(minute=30), day.replace(minute=30, microsecond=500000), None, None, None]


@pytest.mark.parametrize("top", [3, 1000])
def test_joins_without_keys_go_by_ranges(spark, monkeypatch, top):
    monkeypatch.setattr(joins, "_RANGE", 20)
    draw = random.Random(top)
    a = [(i, None if i == 7 else draw.randrange(2 * top) / 2) for i in range(400)]
    b = [(i, None if i == 7 else draw.randrange(top // 3, top) + 0.0) for i in range(100)]
    left, right = spark.createDataFrame(a, "id int, t double").coalesce(1), spark.createDataFrame(b, "n int, u double").coalesce(1)
    known = sorted((u, n) for n, u in b if u is not None)
    want = {"lower": [], "upper": [], "nearest": []}
    for i, t in a:
        if t is None:
            continue
        low, up = [x for x in known if x[0] <= t][-1:], [x for x in known if x[0] > t][:1]
        want["lower"] += [(i, n) for _, n in low]
        want["upper"] += [(i, n) for _, n in up]
        want["nearest"] += [(i, (low if not up or low and t - low[0][0] < up[0][0] - t else up)[0][1])]
    for how, pairs in want.items():
        got = joins.time_join(left, right, "t", "u", [], how, bound_order=["n"]).select("id", "bound.n")
        assert sorted(map(tuple, got.collect())) == pairs
        assert "windowspecdefinition(__range" in got._jdf.queryExecution().analyzed().toString().replace("#", "")
    named = left.withColumn("k", F.expr("id % 150"))
    got = joins.radius_join(named, right, "t", "u", 2.0, nearest=["k"]).select("k", "id", "n")
    best = {}
    for i, t in a:
        for u, _ in known if t is not None else []:
            if abs(t - u) <= 2.0:
                best[i % 150] = min(best.get(i % 150, (9, 9)), (abs(t - u), u))
    pairs = sorted((i % 150, i, n) for i, t in a if t is not None and i % 150 in best for u, n in known if u == best[i % 150][1] and abs(t - u) <= 2.0)
    assert sorted(map(tuple, got.collect())) == pairs


def test_large_cells_are_dealt_over_partitions(spark, monkeypatch):
    draw = random.Random(8)
    a = [(i, draw.choice([5.0, 5.25, draw.uniform(0, 40)]), float(draw.randrange(3))) for i in range(200)]
    b = [(i, draw.choice([5.0, draw.uniform(0, 40)]), float(draw.randrange(3))) for i in range(150)]
    left, right = spark.createDataFrame(a, "i int, x double, p double").coalesce(1), spark.createDataFrame(b, "j int, y double, q double").coalesce(1)
    spans = spark.createDataFrame([(j, y, y + 1.5) for j, y, _ in b], "j int, low double, high double")
    near = sorted((i, j) for i, x, p in a for j, y, q in b if ((x - y) ** 2 + (p - q) ** 2) ** 0.5 <= 1.5)
    inside = sorted((i, j) for i, x, _ in a for j, y, _ in b if y <= x < y + 1.5)
    for name, value in (("_SMALL", 0), ("_PAIRS", 50), ("_PARTS", 6)):
        monkeypatch.setattr(joins, name, value)
    got = joins.radius_join(left, right, ["x", "p"], ["y", "q"], 1.5).select("i", "j")
    assert got.rdd.getNumPartitions() == 6
    assert sorted(map(tuple, got.collect())) == near
    assert sorted(map(tuple, joins.interval_join(left, spans, "x", "low", "high", 1.5).select("i", "j").collect())) == inside


def test_erasing_a_running_value(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, "a", None, "z", None, "b"])], "t int, v string")
    assert [r.v for r in rows.running_update(df, ["v"], [], ["t"], erase="z").orderBy("t").collect()] == [None, "a", "a", None, None, "b"]
    assert rows.running_update(df.limit(5), ["v"], [], ["t"], last_only=True, erase="z").first().v is None


def test_times_as_text(spark):
    df = spark.createDataFrame([("2014-03-05T23:00:00.000Z",), ("20140305T230000",), ("1394060400",), ("2014-03-05 23:00:00",), ("2014-03-06T10:00:00+11:00",), ("2014-03-05T12:30:00-1030",), ("2014-03-06T10:00:00+11",)], "x string")
    assert {r[0] for r in df.select(scalar.format_time(scalar.parse_time(F.col("x")), "xsd")).collect()} == {"2014-03-05T23:00:00"}
    t = scalar.parse_time(F.col("x"))
    row = df.limit(1).select(*(scalar.format_time(t, k) for k in ("iso", "seconds", "microseconds", "sql", "iso-always-with-fractions")), scalar.format_time(t, "local", "Australia/Sydney")).first()
    assert tuple(row) == ("20140305T230000", "1394060400", "1394060400000000", "2014-03-05 23:00:00", "20140305T230000.000000", "20140306T100000")
    odd = spark.createDataFrame([("",), (None,), ("not-a-date-time",), ("x",)], "x string")
    assert odd.filter(scalar.parse_time(F.col("x")).isNotNull()).count() == 0
    with pytest.raises(Exception, match="expected a time"):
        odd.select(scalar.parse_time(F.col("x"), strict=True)).collect()


def test_paths_and_numbers(spark):
    df = spark.createDataFrame([("/a/b/c",), ("a/b/c",), ("a",), ("/",)], "p string")
    got = [tuple(r) for r in df.select(scalar.path_basename(F.col("p"), head=1), scalar.path_dirname(F.col("p"), head=1), scalar.path_normal(F.col("p"))).collect()]
    assert got == [("a/b/c", "/a", "/a/b/c"), ("b/c", "a", "a/b/c"), ("a", "a", "a"), ("", "/", "/")]
    normal = spark.createDataFrame([("/../a/./b/../c//",), ("../x/../y",), ("a/..",)], "p string")
    assert [r[0] for r in normal.select(scalar.path_normal(F.col("p"))).collect()] == ["/a/c", "../y", "."]
    x = spark.createDataFrame([(1.0, 1.0 + 1e-17), (1.0, 1.1), (float("nan"), float("nan"))], "a double, b double")
    assert [r[0] for r in x.select(scalar.equal_within(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    with pytest.raises(ValueError, match="grid"):
        scalar.interpolate([F.lit(1.0)], [[1.0]], (1,), (0.0,), (1.0,))


def test_packets(spark):
    packet = lambda p: p + scalar.crc_bytes(p).to_bytes(2, "little")
    good = [bytes([k] * 6) for k in range(1, 5)]
    stream = packet(good[0]) + b"garbage" + packet(good[1]) + packet(good[2]) + b"\xff" + packet(good[3])
    assert scalar.recovered_packets(stream, 6) == good
    assert scalar.recovered_packets(stream, 6, after=2) == good[:3]
    for which, want in (("16", 0xBB3D), ("ccitt", 0x29B1), ("xmodem", 0x31C3), ("32", 0xCBF43926)):
        assert scalar.crc_bytes(b"123456789", which) == want
    df = spark.createDataFrame([("abc,1",)], "l string")
    with pytest.raises(Exception, match="checksum fails"):
        df.select(scalar.crc_checked(F.col("l"))).collect()


def test_tree_texts(spark):
    leaves = [("a/b", "1"), ("a/c", "two words"), ("d", "x")]
    for kind in ("json", "xml", "ini", "info", "path-value"):
        rooted = [(f"r/{p}", v) for p, v in leaves] if kind == "xml" else leaves
        assert sorted(forms.parse(forms.render(rooted, kind), kind)) == sorted(rooted)
    assert forms.parse("a=1\na=2\n/b=\"q\"", "path-value", take_last=True) == [("a", "2"), ("b", "q")]
    with pytest.raises(ValueError, match="more than once"):
        forms.parse("a=1\na=2", "path-value", unique=True)
    assert '"a" -> "a/b"' in forms.render(leaves, "dot")
    d = forms.tree([("a/b[1]/c", "x"), ("a/b[0]", "y")])
    assert d == {"a": {"b": ["y", {"c": "x"}]}} and forms.at(d, "a/b[1]/c") == "x" and not forms.has(d, "a/b[2]")
    assert forms.leaves(d) == [("a/b[0]", "y"), ("a/b[1]/c", "x")] and forms.parents("a/b/c") == ["a", "a/b"]
    assert forms.updated({"a": {"x": "1", "y": "2"}}, {"a": {"y": "3"}}) == {"a": {"x": "1", "y": "3"}} and forms.set_at({"a": "1"}, "b/c", "2") == {"a": "1", "b": {"c": "2"}}
    deep = spark.createDataFrame([(0, '{"a":' * 14 + "1" + "}" * 14)], "k int, doc string")
    assert [r.path for r in trees.flatten_tree(deep, "doc", ["k"]).collect()] == ["/".join("a" * 14)]
    xml = b"<r><p id='1'>x<p>y</p></p><q/><p/></r>"
    files = spark.createDataFrame([("f", bytearray(xml))], "path string, content binary")
    assert [xml[r.begin : r.end] for r in trees.element_offsets(files, "p").orderBy("begin").collect()] == [b"<p id='1'>x<p>y</p></p>", b"<p>y</p>", b"<p/>"]


def test_expressions_beyond_columns(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "t int, x double")
    assert [r.y for r in expressions.evaluate_batches(df, "y=nextafter(x,x)+heaviside(x-2,0.5)").orderBy("t").collect()] == [0, 1, 2.5, 4, 5]
    got = expressions.evaluate_running(df, "last=x-before;before=x", {"before": 0.0, "last": 0.0}, [], ["t"]).orderBy("t").collect()
    assert [r["last"] for r in got] == [0, 1, 1, 1, 1]
    for code in ("y=open('f')", "y=x.__class__", "y=seterr(all='ignore')"):
        with pytest.raises(Exception, match="can't express"):
            expressions.evaluate_batches(df, code).collect()
    with pytest.raises(Exception, match="x > 3"):
        expressions.until(df, "x > 3", [], ["t"], with_error=True).collect()


def test_random_values_in_a_range(spark):
    for distribution in ("uniform", "normal", "exponential"):
        got = np.array([r.value for r in generate.random_values(spark, 4000, distribution, 1.0, 2.0, seed=3, between=(0.5, 1.5)).collect()])
        assert got.min() >= 0.5 - 1e-6 and got.max() <= 1.5 + 1e-6 and got.std() > 0.1
    assert generate.random_values(spark, 10, "uniform", 0, 100, kind="int").dtypes == [("value", "int")]
    with pytest.raises(Exception, match="not among"):
        generate.seek(spark.createDataFrame([(9,)], "i int"), spark.range(5).toDF("k"), ["k"], index="i").collect()
    assert generate.seek(spark.createDataFrame([(9,), (2,)], "i int"), spark.range(5).toDF("k"), ["k"], index="i", permissive=True).select("record.k").first().k == 2


def streamed(spark, tmp_path, name, schema, batches):
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}")


def collected(spark, tmp_path, df, name, silent=False):
    """With timers of processing time a query is never done, so it is looked at for a while."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
    if silent:
        began = time.time()
        while time.time() < began + 20 and not spark.table(name).count():
            time.sleep(0.5)
    else:
        q.processAllAvailable()
    q.stop()
    return tuples(spark.table(name))


def test_streams_with_state(spark, tmp_path):
    left = streamed(spark, tmp_path, "l", "k long, t long, v double", [[(1, 10, 1.0), (1, 20, 2.0), (1, 40, 4.0)]])
    right = streamed(spark, tmp_path, "r", "k long, t long, v double", [[(1, 5, 0.5), (1, 15, 9.0), (1, 30, 3.0)]])
    assert collected(spark, tmp_path, latest.bounded_join(left, right, "k", "t", "v"), "bounded") == [(1, 10, 1.0, 0.5), (1, 20, 2.0, 9.0)]
    assert collected(spark, tmp_path, latest.gate(left, right, "k", "t", "v", 1.0), "gated") == [(1, 20, 2.0), (1, 40, 4.0)]
    blocks_ = streamed(spark, tmp_path, "b", "k long, b long, v double", [[(1, 0, 1.0), (1, 0, 3.0), (1, 1, 5.0)]])
    assert collected(spark, tmp_path, latest.block_totals(blocks_, "k", "b", "v"), "totals") == [(1, 0, 2, 4.0, 1.0, 3.0)]
    assert len(collected(spark, tmp_path, latest.thin_by_clock(blocks_, "k", "v", 60_000), "thinned")) == 1
    updates = streamed(spark, tmp_path, "u", "k long, t long, x string, y string", [[(1, 1, "a", None), (1, 2, None, "b")]])
    assert collected(spark, tmp_path, latest.running_update(updates, "k", "t", ["x", "y"]), "updated") == [(1, 1, "a", None), (1, 2, "a", "b")]


def test_streams_on_silence(spark, tmp_path):
    df = streamed(spark, tmp_path, "s", "k long, v double", [[(1, 1.0), (2, 2.0)]])
    assert (1, 1.0, 0) in collected(spark, tmp_path, latest.hold_last(df, "k", "v", 60_000), "held", silent=True)
    assert (1, 1000) in collected(spark, tmp_path, latest.watchdog(df, "k", 1000), "watched", silent=True)
    timed = streamed(spark, tmp_path, "w", "t timestamp, line string", [[(T0, "abc"), (T0 + datetime.timedelta(seconds=1), "de")]])
    q = latest.bandwidth(timed, "t", "line", "10 seconds", "10 seconds", "1 second").writeStream.format("memory").queryName("width").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp-width").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.records, r.bytes) for r in spark.table("width").collect()] == [(2, 5)]


def test_streams_to_several_sinks(spark, tmp_path):
    df = streamed(spark, tmp_path, "m", "k string, v int", [[("a", 1), ("b", 2), ("c", 3), (None, 4)]])
    got = {"a": [], "rest": [], "every": []}
    keep = lambda name: lambda batch: got[name].extend(r.v for r in batch.collect())
    for n, writer in enumerate((latest.routed(df, "k", {"a": keep("a")}, keep("rest")), latest.tee(df, keep("every")))):
        q = writer.option("checkpointLocation", f"{tmp_path}/cp-m{n}").start()
        q.processAllAvailable()
        q.stop()
    assert got["a"] == [1] and sorted(got["rest"]) == [2, 3, 4] and sorted(got["every"]) == [1, 2, 3, 4]
