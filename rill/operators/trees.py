"""Property trees: documents as (doc, path, value) rows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def flatten_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row a leaf of a flat JSON object: path and value, as text."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))


def to_columns(paths: DataFrame, keys: list[str], wanted: list[str]) -> DataFrame:
    """Path rows back to a record: one column for each wanted path."""
    return paths.filter(F.col("path").isin(wanted)).groupBy(*keys).agg(*(F.max(F.when(F.col("path") == p, F.col("value"))).alias(p) for p in wanted))


def from_columns(df: DataFrame, keys: list[str], prefix: str = "", index: str | None = None) -> DataFrame:
    """Every other column as a path row; nulls have none. index: the column whose number stands in brackets after the
    prefix, as `prefix[3]/field`."""
    fields = [c for c in df.columns if c not in keys]
    above = F.lit(prefix) if index is None else F.concat(F.lit(prefix.rstrip("/") + "["), F.col(index).cast("string"), F.lit("]/"))
    rows = F.explode(F.array(*(F.struct(F.concat(above, F.lit(c)).alias("path"), F.col(c).cast("string").alias("value")) for c in fields))).alias("r")
    return df.select(*keys, rows).select(*keys, "r.path", "r.value").filter("value is not null")


def layered(layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Path rows of several layers; the last one that has a path wins, `source` tells which."""
    every = None
    for k, d in enumerate(layers):
        d = d.withColumn("source", F.lit(k))
        every = d if every is None else every.unionByName(d)
    return every.groupBy(*keys, "path").agg(F.max(F.struct("source", "value")).alias("top")).select(*keys, "path", "top.value", "top.source")


def permute(spark: SparkSession, lists: dict[str, Column]) -> DataFrame:
    """Every combination of the values of named arrays (a list of literals, or a sequence), a column each."""
    out = spark.range(1)
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(values))
    return out.select(*lists)


def indexed_to_columns(paths: DataFrame, keys: list[str], wanted: list[str], prefix: str = "") -> DataFrame:
    """Rows `prefix[3]/field` back to records, one an index: `index` and a column for each wanted field."""
    pattern = "^" + re.escape(prefix.rstrip("/")) + r"\[([0-9]+)\]/(.*)$"
    known = paths.filter(F.col("path").rlike(pattern)).select(*keys, F.regexp_extract("path", pattern, 1).cast("long").alias("index"), F.regexp_extract("path", pattern, 2).alias("path"), "value")
    return to_columns(known, [*keys, "index"], wanted)


def stream_to_columns(paths: DataFrame, keys: list[str], wanted: list[str], order: list[str], every: bool = False) -> DataFrame:
    """A stream of path rows without indices as records: a record ends where a path comes again, and holds the values
    since the last one ended; with every, each row gives the latest values of all fields instead."""
    known = paths.filter(F.col("path").isin(wanted))
    w = Window.partitionBy(*keys).orderBy(*order)
    values = [F.when(F.col("path") == p, F.col("value")).alias(p) for p in wanted]
    if every:
        return known.select(*keys, *(F.last(v, True).over(w).alias(p) for v, p in zip(values, wanted, strict=True)))
    # the n-th time that a path comes is the n-th record's, in streams that repeat the same fields
    placed = known.withColumn("record", (F.row_number().over(Window.partitionBy(*keys, "path").orderBy(*order)) - 1).cast("long"))
    return to_columns(placed, [*keys, "record"], wanted)


def flatten_tree(df: DataFrame, column: str, keys: list[str], depth: int | None = None) -> DataFrame:
    """One row a leaf of a JSON document, with paths such as `a/b[0]/c` and values as text; null leaves have a null
    value, empty objects and arrays none. Malformed documents and nulls give no rows. A lateral join a level, within the
    task; no shuffle. Without a depth the levels are counted first, in one pass over the documents, so leaves of any
    depth come out; with one, what lies deeper stays together, as JSON text."""
    if depth is None:
        opened = F.length(F.regexp_replace(F.col(column), r"[^\[{]", ""))
        depth = df.agg(F.max(opened)).first()[0] or 0
        if depth > 8:  # brackets bound the depth; the exact one takes a look at how they nest
            depth = _depth(df, column)
    out = df.select(*keys, F.lit("").alias("path"), F.try_parse_json(column).alias("value")).filter("value is not null")
    for _ in range(depth):
        inner = out.sparkSession.tvf.variant_explode_outer(F.col("__whole").outer())
        child = F.when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws("/", "path", "key"))
        step = out.withColumnRenamed("value", "__whole").lateralJoin(inner)
        out = step.select(*keys, F.when(F.col("pos").isNull(), F.col("path")).otherwise(child).alias("path"), F.when(F.col("pos").isNull(), F.col("__whole")).otherwise(F.col("value")).alias("value"))
    text = F.try_variant_get("value", "$", "string")
    empty = text.isin("{}", "[]") & (F.schema_of_variant("value") != "STRING")
    return out.filter(F.is_variant_null("value") | ~empty).select(*keys, "path", F.when(~F.is_variant_null("value"), text).alias("value"))


def _depth(df: DataFrame, column: str) -> int:
    """The most brackets open at once outside of strings, over all documents."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(column), r'"(?:[^"\\]|\\.)*"', ""), r"[\[{]", "("), r"[\]}]", ")")
    signs = F.split(F.regexp_replace(bare, "[^()]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return df.agg(F.max(F.aggregate(signs, zero, step)["most"])).first()[0] or 0


def under(paths: DataFrame, wanted: str, regex: bool = False) -> DataFrame:
    """Path rows at or below a path, or whose path matches a regular expression."""
    p = F.col("path")
    return paths.filter(p.rlike(wanted) if regex else (p == wanted) | p.startswith(wanted + "/") | p.startswith(wanted + "["))


_ARITHMETIC = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b}
_COMPARISONS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}


def calc_trees(left: DataFrame, right: DataFrame, keys: list[str], op: str, detailed: bool = False, exclude: bool = False) -> DataFrame:
    """Leaf by leaf over two sets of path rows. Arithmetic: path and value; leaves that one side lacks, or that are no
    numbers, keep the left value (or the only one), or go with exclude. Comparisons, on leaves of both: a flag a
    document, 1 if it holds for all, or with detailed a flag a leaf."""
    a, b = (d.select(*keys, "path", F.col("value").alias(n)) for d, n in ((left, "__a"), (right, "__b")))
    x, y = F.expr("try_cast(__a as double)"), F.expr("try_cast(__b as double)")
    if op in _COMPARISONS:
        flag = F.coalesce(_COMPARISONS[op](x, y), F.lit(False)).cast("int")
        flags = a.join(b, [*keys, "path"]).filter(x.isNotNull() | y.isNotNull()).select(*keys, "path", flag.alias("value"))
        return flags if detailed else flags.groupBy(*keys).agg(F.min("value").alias("value"))
    if op not in _ARITHMETIC:
        raise ValueError(f"operation {op!r}: expected one of {', '.join([*_ARITHMETIC, *_COMPARISONS])}")
    made = _ARITHMETIC[op](x, F.nullif(y, F.lit(0.0)) if op == "div" else y).cast("string")
    both = a.join(b, [*keys, "path"], "inner" if exclude else "full_outer")
    value = made if exclude else F.coalesce(made, F.col("__a"), F.col("__b"))
    out = both.select(*keys, "path", value.alias("value"))
    return out.filter("value is not null") if exclude else out


def xml_values(document: Column, path: str) -> Column:
    """The values at a path of an XML document: an array of text."""
    return F.xpath(document, F.lit(path))


def read_elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag in XML files as records; large files are split among tasks."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def split_elements(spark: SparkSession, path: str, tag: str, schema: str, by: list[str], folder: str) -> None:
    """The elements of a tag in XML files to files of their own, a folder for each value of the by columns."""
    read_elements(spark, path, tag, schema).write.partitionBy(*by).format("xml").option("rowTag", tag).option("rootTag", tag + "s").save(folder)


def _after(data: bytes, begin: int, at: int) -> int:
    """The byte after an element that begins at a place, and whose end the parser reports at another."""
    opening = re.compile(rb"""<(?:[^>"']|"[^"]*"|'[^']*')*>""").match(data, begin)
    return opening.end() if opening.group().endswith(b"/>") else data.index(b">", at) + 1


def element_offsets(files: DataFrame, tag: str, content: str = "content", path: str = "path") -> DataFrame:
    """From rows of whole XML files (path, content): each element of a tag with the byte its markup begins at and the byte
    after its end, so that it can be cut out of the file. Elements of the tag within one another are all given."""
    from xml.parsers import expat

    def run(batches):
        for b in batches:
            out = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                parser, open_, found = expat.ParserCreate(), [], []

                def begin(t, _, p=parser, o=open_):
                    if t == tag:
                        o.append(p.CurrentByteIndex)

                def end(t, p=parser, o=open_, f=found, d=data):
                    if t == tag:
                        at = p.CurrentByteIndex
                        start = o.pop()
                        f.append((start, _after(d, start, at)))

                parser.StartElementHandler, parser.EndElementHandler = begin, end
                parser.Parse(data, True)
                out += [(name, *x) for x in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.string()), pa.array([x[1] for x in out], type=pa.int64()), pa.array([x[2] for x in out], type=pa.int64())], names=["path", "begin", "end"])

    return files.select(path, F.col(content).cast("binary")).mapInArrow(run, "path string, begin long, end long")
