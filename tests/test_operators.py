"""Golden cases of what SQL can't express or the registered queries don't reach."""

import pytest
from pyspark.sql import functions as F

from rill.functions import expressions, fields, scalar
from rill.operators import blocks, calc, joins, rows, trees
from rill.sources import generate, records
from rill.streaming import latest


def test_state_machine(spark):
    e = spark.createDataFrame([(k, 0, x) for k, x in enumerate("aababc")], "t int, id int, event string")
    moves = spark.createDataFrame([("a", 0, 1), ("b", 1, 0), ("c", 0, 5)], "event string, state int, next_state int")
    got = joins.state_join(e, moves, 0, ["id"], ["t"]).orderBy("t").select("t", "state", "next_state").collect()
    assert [tuple(r) for r in got] == [(0, 0, 1), (2, 1, 0), (3, 0, 1), (4, 1, 0), (5, 0, 5)]


def test_percentile_interpolated(spark):
    df = spark.createDataFrame([(1, float(x)) for x in range(1, 1001)], "g int, x double")
    row = calc.calc(df, ["percentile=0.9:interpolate", "percentile=0.9"], ["x"], ["g"]).first()
    assert (row.x_percentile_0_9_interpolate, row.x_percentile_0_9) == (pytest.approx(900.9), 900.0)


def test_moments_of_a_sample(spark):
    df = spark.createDataFrame([(1, x) for x in (1.0, 2.0, 3.0, 4.0, 6.0)], "g int, x double")
    row = calc.calc(df, ["kurtosis", "kurtosis=sample", "kurtosis=sample:excess", "skew", "skew=sample", "var", "var=sample"], ["x"], ["g"]).first().asDict()
    want = {"x_kurtosis": 1.9945, "x_kurtosis_sample": 2.9781, "x_kurtosis_sample_excess": -0.0219, "x_skew": 0.39587, "x_skew_sample": 0.59013, "x_var": 2.96, "x_var_sample": 3.7}
    assert {k: row[k] for k in want} == pytest.approx(want, abs=1e-4)
    few = calc.calc(df.limit(3), ["kurtosis=sample"], ["x"], ["g"]).first()
    assert few.x_kurtosis_sample != few.x_kurtosis_sample


def test_span_blocks(spark):
    df = spark.createDataFrame([(0, k, x) for k, x in enumerate((1.1, 2.0, 5.0, 5.9, 9.0))], "id int, t int, x double")
    got = blocks.group_by_span(df, "x", 3.0, ["id"], ["t"]).orderBy("t").select("block").collect()
    assert [r.block for r in got] == [0, 0, 1, 1, 2]


def test_thin(spark):
    df = spark.range(1, 21).withColumn("g", F.lit(0))
    assert [r.id for r in rows.thin(df, 0.25, ["g"], ["id"]).orderBy("id").collect()] == [4, 8, 12, 16, 20]


def test_require_matched(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.require_matched(a.filter("k = 1"), b, ["k"]).count() == 1
    with pytest.raises(Exception, match="no match"):
        joins.require_matched(a, b, ["k"]).collect()


def test_formats():
    assert records.expand_format("2d,s[4],ui") == ["d", "d", "s[4]", "ui"]
    assert records.format_size("2d,s[4],ui") == 24
    assert records.collapse_format("d,d,ui") == "2d,ui"
    with pytest.raises(ValueError):
        records.expand_format("q")


def test_text_records(spark):
    lines = spark.createDataFrame([('1,"a b",20200101T000000.5\r',), ("",), ("2,,",)], "value string")
    got = records.from_lines(lines, "n,,t", "l,s[9],t").orderBy("n").collect()
    assert [r.n for r in got] == [1, 2] and got[0].t.microsecond == 500000 and got[1].t is None


def test_signed_binary(spark):
    df = spark.createDataFrame([(-5, -3, 7)], "a byte, b int, c long")
    got = records.unpack(records.pack(df, "b,i,l"), "b,i,l", ["a", "b", "c"]).first()
    assert tuple(got) == (-5, -3, 7)


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert tuple(expressions.evaluate(df, "x=x+y;z=where(x>2,maximum(x,y),0)").first()) == (3.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        expressions.evaluate(df, "z=__import__('os')")


def test_paths_and_quotes(spark):
    df = spark.createDataFrame([("a/b/c",), ("/aaa",), ("x",)], "p string")
    got = df.select(scalar.path_basename(F.col("p")), scalar.path_dirname(F.col("p")), scalar.quoted(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("c", "a/b", '"a/b/c"'), ("aaa", "/", '"/aaa"'), ("x", "", '"x"')]


def test_latest_join_stream(spark, tmp_path):
    for name, data in (("l", [(1, 10, 1.0), (1, 20, 2.0), (2, 5, 3.0)]), ("r", [(1, 15, 9.0), (2, 6, 8.0)])):
        spark.createDataFrame(data, "k long, t long, v double").write.parquet(f"{tmp_path}/{name}")
    left, right = (spark.readStream.schema("k long, t long, v double").parquet(f"{tmp_path}/{x}") for x in "lr")
    q = latest.latest_join(left, right, "k", "t", "v").writeStream.format("memory").queryName("latest").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("latest").collect()] == [(1, 20, 2.0, 9.0)]


def test_sliding_sort(spark):
    keys = {"a": [5, 1, 4, None, 2, 2, 9, 0], "b": [3]}
    df = spark.createDataFrame([(g, t, k) for g, ks in keys.items() for t, k in enumerate(ks)], "g string, t int, k int")
    for tail in (False, True):
        want = []
        for g, ks in keys.items():
            held, place = [], 0
            for t, k in enumerate(ks):
                held.append((-1 if k is None else k, t))
                if len(held) == 3:
                    want.append((g, place, min(held)[1]))
                    held.remove(min(held))
                    place += 1
            want += [(g, place + i, t) for i, (_, t) in enumerate(sorted(held))] if tail else []
        got = rows.sliding_sort(df, "k", 3, ["g"], ["t"], tail).select("g", "place", "t").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_enumerate_keys_in_ranges(spark):
    df = spark.createDataFrame([(k, (k * 37) % 101 + 200 * r) for k in range(101) for r in range(3)], "k int, t int")
    got = {r.k: (r.id, r["count"]) for r in rows.enumerate_keys(df, ["k"], ["t"]).collect()}
    assert got == {k: ((k * 37) % 101, 3) for k in range(101)}
    assert rows.enumerate_keys(df.filter("false"), ["k"], ["t"]).count() == 0


def test_crc_and_permute(spark):
    df = spark.createDataFrame([(bytearray(b"123456789"),), (bytearray(),), (None,)], "d binary")
    got = df.select(*(scalar.crc(F.col("d"), w) for w in ("16", "ccitt", "xmodem", "32"))).collect()
    assert [tuple(r) for r in got] == [(0xBB3D, 0x29B1, 0x31C3, 0xCBF43926), (0, 0xFFFF, 0, 0), (None,) * 4]
    assert trees.permute(spark, {"x": F.array(F.lit(1), F.lit(2)), "y": F.sequence(F.lit(0), F.lit(2))}).count() == 6


def test_contain_open_bounds_and_nulls(spark):
    df = spark.createDataFrame([(None,), (-9.0,), (1.0,), (2.0,), (5.0,), (5.5,), (50.0,)], "x double")
    spans = spark.createDataFrame([(1.0, 2.0), (5.0, 5.0), (1.0, 1.5), (5.2, 9.0), (None, -5.0), (40.0, None)], "low double, high double")
    got = {r.x: r.contained for r in joins.contain(df, spans, "x", "low", "high", 2.0).collect()}
    assert got == {None: 0, -9.0: 1, 1.0: 1, 2.0: 0, 5.0: 0, 5.5: 1, 50.0: 1}
    everything = spans.unionByName(spark.createDataFrame([(None, None)], spans.schema))
    assert joins.contain(df, everything, "x", "low", "high", 2.0).agg(F.sum("contained")).first()[0] == 6
    assert joins.contain(df, spans.filter("false"), "x", "low", "high", 2.0).agg(F.sum("contained"), F.count("*")).first() == (0, 7)


def test_block_wise_is_positional(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (7, 1), (9, 1)], "block int, id int")
    b = spark.createDataFrame([(100, 1), (200, 2), (200, 1)], "block int, id int")
    got = joins.block_wise(a, b, "block", [], ["id"]).select("block", "other_block", "id").collect()
    assert sorted(map(tuple, got)) == [(0, 100, 1), (7, 200, 1)]


def test_accumulate_and_last_block(spark):
    df = spark.createDataFrame([(0, "a", 0, 1), (0, "a", 1, 2), (0, "b", 2, 3), (1, "b", 3, 4), (2, "c", 4, None)], "block int, id string, t int, v int")
    got = blocks.accumulate(df, ["id"], [], ["t"]).select("block", "id", "v").collect()
    assert sorted(got, key=lambda r: (r.block, r.id)) == [(0, "a", 2), (0, "b", 3), (1, "a", 2), (1, "b", 4), (2, "a", 2), (2, "b", 4), (2, "c", None)]
    assert sorted(r.t for r in blocks.last_block(df, ["id"]).collect()) == [0, 1, 3, 4]
    assert blocks.accumulate(df.filter("false"), ["id"], [], ["t"]).count() == 0


def test_samples(spark):
    df = spark.createDataFrame([(b, k) for b in range(3) for k in range(4 * b)], "b int, k int")
    got = rows.sample_size(df, 5, ["b"], ["b", "k"], seed=1).groupBy("b").count().collect()
    assert sorted(map(tuple, got)) == [(1, 4), (2, 5)]
    more = rows.sample_size(df.repartition(7), 5, ["b"], ["b", "k"], seed=1)
    assert more.exceptAll(rows.sample_size(df, 5, ["b"], ["b", "k"], seed=1)).count() == 0
    assert rows.sample_ratio(df, 1.0, ["b", "k"]).count() == df.count()
    assert rows.sample_ratio(df, 0.0, ["b", "k"]).count() == 0
    assert 4500 < rows.sample_ratio(spark.range(10000).toDF("k"), 0.5, ["k"], seed=3).count() < 5500
    assert rows.shuffled(df, ["b", "k"], 1).collect() == rows.shuffled(df.repartition(5), ["b", "k"], 1).collect()


def test_replay_and_split_rows(spark):
    a = spark.sql("select timestamp'2024-01-01 00:00:10' as t union all select timestamp'2024-01-01 00:00:30'")
    b = spark.sql("select timestamp'2024-01-01 00:00:20' as t")
    assert [(r.source, r.after) for r in rows.replay([a, b], "t", 2.0).collect()] == [(0, 0.0), (1, 5.0), (0, 10.0)]
    assert [r.source for r in rows.replay([a, b], "t", since=F.lit("2024-01-01 00:00:15").cast("timestamp")).collect()] == [1, 0]
    df = spark.createDataFrame([(0, [1, 2, 3, 4, 5]), (1, [])], "k int, v array<int>")
    got = rows.split_rows(df, F.col("v"), 2, ["x", "y"]).select("k", "part", "x", "y").collect()
    assert sorted(got, key=lambda r: (r.k, r.part)) == [(0, 0, 1, 2), (0, 1, 3, 4), (0, 2, 5, None), (1, 0, None, None)]


def test_paths_and_fixed_lines(spark):
    common = lambda *p: spark.createDataFrame([(x,) for x in p], "p string").agg(scalar.path_common(F.col("p"))).first()[0]
    assert common("a/b/c", "a/b/d", "a/bc") == "a"
    assert common("a/b", "a/b/c") == "a/b"
    assert common("a", "b") == ""
    assert common("/x/y", "/x/y") == "/x/y"
    lines = spark.createDataFrame([("a,b,c",), ("a",), ("",), ("a,,",)], "l string")
    assert [r[0] for r in lines.select(scalar.make_fixed(F.col("l"), 2, ",", "-")).collect()] == ["a,b", "a,-", ",-", "a,"]


def test_headers(spark):
    assert fields.numbers("a,b,c", 1, "f") == "f1,f2,f3"
    assert fields.cleared("t,p/x,p/y", keep="p") == ",p/x,p/y"
    assert fields.cleared("t,p/x,p/y", mask="p") == "t,,"
    assert fields.cut("t,p/x,px", wanted="p") == "p/x"
    assert fields.cut("t,p/x,px", but="p,t") == "px"
    assert fields.default("a,,b", "z") == "a,z,b"
    assert fields.has("p/x,t", "p,t") and not fields.has("a", "a,b") and fields.has("a", "a,b", any_of=True)
    assert fields.prefixed("a,,b", "n", path=True, but="b") == "n/a,,b"
    assert fields.stripped("na,b", "n") == "a,b" and fields.basenames("a/b/c,d") == "c,d"
    assert fields.renamed("p/x,px,t", "p,t", "q,u") == "q/x,px,u"
    df = spark.createDataFrame([(1, "x")], "a int, `p/q` string")
    assert fields.shuffle(df, "p/q,,a,a").columns == ["p/q", "empty_1", "a", "a_1"]


def test_generators(spark, tmp_path):
    numbers = lambda **k: [r.number for r in generate.line_numbers(spark, 5, **k).collect()]
    assert numbers(begin=1, block_size=2) == [1, 1, 2, 2, 3]
    assert numbers(block_size=3, index=True, reverse=True) == [2, 1, 0, 2, 1]
    assert numbers(begin=9, step=2, reverse=True) == [9, 7, 5, 3, 1]
    assert [tuple(r) for r in generate.indices(spark, [2, 2]).collect()] == [(0, 0), (0, 1), (1, 0), (1, 1)]
    made = generate.random_values(spark, 5000, "normal", 3.0, 2.0, seed=1, parts=3).agg(F.mean("value"), F.stddev("value")).first()
    assert abs(made[0] - 3) < 0.2 and abs(made[1] - 2) < 0.2
    with pytest.raises(ValueError, match="expected one of"):
        generate.random_values(spark, 1, "zipf")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "id int, v string")
    generate.split_to_files(df, ["id"], f"{tmp_path}/parts")
    assert sorted(p.name for p in (tmp_path / "parts").glob("id=*")) == ["id=1", "id=2"]
    assert spark.read.parquet(f"{tmp_path}/parts").count() == 3


def test_flatten_tree(spark):
    docs = ['{"a":{"b":[1,{"c":"x"}],"n":null},"e":{},"f":"{}","d":1.5}', "[true,2]", "7", "{bad", None, "{}"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    got = sorted((r.k, r.path, r.value) for r in trees.flatten_tree(df, "doc", ["k"]).collect())
    assert got == [(0, "a/b[0]", "1"), (0, "a/b[1]/c", "x"), (0, "a/n", None), (0, "d", "1.5"), (0, "f", "{}"), (1, "[0]", "true"), (1, "[1]", "2"), (2, "", "7")]
    shallow = {r.path: r.value for r in trees.flatten_tree(df.filter("k = 0"), "doc", ["k"], depth=2).collect()}
    assert shallow["a/b"] == '[1,{"c":"x"}]'
    paths = trees.flatten_tree(df, "doc", ["k"])
    assert sorted(r.path for r in trees.under(paths, "a/b").collect()) == ["a/b[0]", "a/b[1]/c"]
    assert [r.path for r in trees.under(paths, "^a/n$", regex=True).collect()] == ["a/n"]


def test_calc_trees(spark):
    rows_of = lambda d: spark.createDataFrame([(0, p, v) for p, v in d.items()], "k int, path string, value string")
    a, b = rows_of({"x": "6", "y": "1", "s": "t", "only": "4"}), rows_of({"x": "2", "y": "0", "s": "u", "more": "5"})
    full = {r.path: r.value for r in trees.calc_trees(a, b, ["k"], "div").collect()}
    assert full == {"x": "3.0", "y": "1", "s": "t", "only": "4", "more": "5"}
    assert {r.path: r.value for r in trees.calc_trees(a, b, ["k"], "add", exclude=True).collect()} == {"x": "8.0", "y": "1.0"}
    assert [tuple(r) for r in trees.calc_trees(a, b, ["k"], "gt").collect()] == [(0, 1)]
    assert {r.path: r.value for r in trees.calc_trees(a, b, ["k"], "lt", detailed=True).collect()} == {"x": 0, "y": 0}
    with pytest.raises(ValueError, match="expected one of"):
        trees.calc_trees(a, b, ["k"], "pow")


def test_xml_and_tolerance(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><p><id>1</id><n>x</n></p><q/><p><id>2</id></p></all>")
    got = trees.read_elements(spark, str(tmp_path / "a.xml"), "p", "id int, n string").collect()
    assert sorted((r.id, r.n) for r in got) == [(1, "x"), (2, None)]
    df = spark.createDataFrame([("<a><b>1</b><b>2</b></a>",), (None,)], "d string")
    assert [r[0] for r in df.select(trees.xml_values(F.col("d"), "a/b/text()")).collect()] == [["1", "2"], None]
    xs = spark.createDataFrame([(1.0, 1.2), (1.0, 1.4)], "x double, y double")
    assert xs.filter(expressions.condition(xs, expressions.tolerant("x == y +/- 0.3"))).count() == 1


def test_all_leap_seconds(spark):
    df = spark.sql("select cast(x as timestamp_ntz) t from values ('1971-12-31 23:59:59'), ('1972-01-01'), ('1972-06-30 23:59:59'), ('1972-07-01'), ('1981-06-30'), ('1981-07-01'), ('1998-12-31'), ('1999-01-01'), ('2016-12-31'), ('2017-01-01'), (null) v(x)")
    assert [r[0] for r in df.select(scalar.tai_offset(F.col("t"))).collect()] == [0, 10, 10, 11, 19, 20, 31, 32, 36, 37, None]
    assert len(scalar.LEAP_SECONDS) == 28


def test_floating_point_binary(spark):
    import math
    import struct

    values = [(1.0, 0.1), (-0.0, -2.5), (5e-324, 1e-45), (1.7976931348623157e308, 3.4028234663852886e38), (math.inf, -math.inf), (math.pi, 16777217.0), (math.nan, math.nan)]
    packed = records.pack(spark.createDataFrame(values, "a double, b float").coalesce(1), "d,f")
    raw = [bytes(r.record) for r in packed.collect()]
    assert raw == [struct.pack("<df", *v) for v in values]
    got = [tuple(r) for r in records.unpack(packed, "d,f", ["a", "b"]).collect()]
    assert [struct.pack("<df", *r) for r in got] == raw
    assert records.pack(spark.createDataFrame([(None,)], "a double"), "d").first().record is None
