"""Operator 3: near-duplicate documents by a MinHash LSH forest, links confirmed on full shingle sets.

1. Every document gets TREES short signatures of DEPTH min-hashes each, and a 128-bit digest of its shingle set. Equal
   sets become one class at once (a grouped minimum), so exact copies cost no candidates.
2. For every tree the class representatives are sorted by signature over the whole corpus (a range shuffle on tree,
   signature and id, so a crowded region is cut wherever its rows are many). Candidates are sorted neighbours whose
   common prefix reaches LEAST_DEPTH, and, in each run that shares a prefix at several depths, the run's first row:
   sparse regions meet at small depth, crowded ones at greater depth as well, and the pairs stay linear in the rows.
3. Candidates are confirmed on short sets, 16 bits of each shingle, before full ones: what two short sets share is never
   less than what the full ones do, so a pair that they rule out can't be a link. The full sets travel only for the
   pairs that are left, and decide. First each document meets its most often seen partner; then runs of LEAST_DEPTH that
   hold several components go on (4); the candidates still apart come last. Components are stars built by alternating
   minima.
4. Rows of such a run that agree with a row of another component in enough of all min-hashes are met there, all with all
   of other components, on full sets: the sets of two blocks of a run travel to one cell, where what is linked already
   is passed over, and only links that join components leave it. No row stands for a pair: rows are those of the run,
   once for each of its blocks.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Defined cases: null or empty text, or text without words, has an
empty set, links with nothing and is kept; a text with fewer words than the width is one shingle; equal sets link;
repeated doc_ids are one document with all their texts' links, and each of their rows gets its component; a null doc_id
is kept and links with nothing; no rows give no rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import release
from .common import arrow_map, batch_of, id_text, in_pieces, mix, partitions, saved, shingles, words_of
from .components import components

TREES, DEPTH, LEAST_DEPTH = 16, 6, 3
#: Depths at which a run's first row is a candidate for all its rows, and sorted neighbours on one side.
RUN_DEPTHS, NEIGHBOURS = (3, 4, 5, 6), 2
SIMILAR = 80  # percent
#: Min-hashes of all TREES * DEPTH that a pair of a run must share to be confirmed: 4.8 deviations under 0.8.
LEAST_AGREE = 58
#: Rows of a run in one block, and shingles where full sets meet; a cell is a pair of blocks.
BLOCK_ROWS, BLOCK_SHINGLES = 1024, 1 << 20
#: Shingles hashed at once.
_STRIP = 1 << 14


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:n] | np.uint64(1))[:, None], seed[n:][:, None]


def signature(shingle_set: np.ndarray, factors=None) -> bytes:
    """TREES x DEPTH min-hashes as big-endian unsigned 32-bit integers, tree by tree. The set isn't empty."""
    up, plus = factors or _factors(TREES * DEPTH)
    least = None
    for k in range(0, len(shingle_set), _STRIP):
        part = (shingle_set[None, k : k + _STRIP] * up + plus).min(axis=1)
        least = part if least is None else np.minimum(least, part)
    return (mix(least) >> np.uint64(32)).astype(">u4").tobytes()


def _digest(shingle_set: np.ndarray) -> tuple[int, int]:
    """Of a set of 64-bit hashes, 128 bits; of an empty one, zeros."""
    return (int(shingle_set.sum().view(np.int64)), int(mix(shingle_set).sum().view(np.int64))) if len(shingle_set) else (0, 0)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (digest of the set), signature (null for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary())])

    def run(batches):
        factors = _factors(TREES * DEPTH)
        for b in batches:
            for lo, hi, texts in in_pieces(b):
                h, first, _, _ = words_of(texts)
                n, digests, sign = [], [], []
                for k in range(len(texts)):
                    s = np.unique(shingles(h[first[k] : first[k + 1]], width))
                    n.append(len(s))
                    digests.append(_digest(s))
                    sign.append(signature(s, factors) if len(s) else None)
                yield batch_of(schema, doc_id=b.column("doc_id")[lo:hi], n_shingles=n, set_a=[d[0] for d in digests], set_b=[d[1] for d in digests], signature=sign)

    return arrow_map(id_text(docs), run, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """doc_id, set_a, set_b (digest), shingles (sorted distinct hashes), short (their upper 16 bits)."""
    schema = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("shingles", pa.list_(pa.int64())), ("short", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi, piece in in_pieces(b):
                h, first, _, _ = words_of(piece)
                sets = [np.unique(shingles(h[a:z], width)) for a, z in zip(first, first[1:], strict=False)]
                digests = [_digest(s) for s in sets]
                short = [(s >> np.uint64(48)).astype("<u2").tobytes() for s in sets]
                yield batch_of(schema, doc_id=b.column("doc_id")[lo:hi], set_a=[d[0] for d in digests], set_b=[d[1] for d in digests], shingles=[s.view(np.int64) for s in sets], short=short)

    return arrow_map(texts, run, "doc_id long, set_a long, set_b long, shingles array<long>, short binary")


def most_shared(one: bytes, two: bytes) -> int:
    """How many shingles two sets can share at most, by their short sets: values in common, with repeats."""
    x, y = np.frombuffer(one, dtype="<u2"), np.frombuffer(two, dtype="<u2")
    nth = np.arange(len(x)) - np.searchsorted(x, x)
    return int((nth < np.searchsorted(y, x, side="right") - np.searchsorted(y, x)).sum())


def _size_fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, m) >= SIMILAR * np.maximum(n, m)


def candidate_pairs(reps: DataFrame) -> DataFrame:
    """(a, b, n): pairs of reps that are candidates in n places of the sorted orders. reps: rep, n_shingles, signature."""
    rows = pa.schema([("tree", pa.int32()), ("key", pa.binary()), ("doc", pa.int64()), ("size", pa.int64())])
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    step = 4 * DEPTH

    def spread(batches):
        for b in batches:
            ids, sizes, signs = (b.column(c).to_pylist() for c in ("rep", "n_shingles", "signature"))
            yield batch_of(
                rows,
                tree=np.tile(np.arange(TREES, dtype=np.int32), len(ids)),
                key=[s[k : k + step] for s in signs for k in range(0, TREES * step, step)],
                doc=np.repeat(np.array(ids, dtype=np.int64), TREES),
                size=np.repeat(np.array(sizes, dtype=np.int64), TREES),
            )

    def meet(batches):
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        t = pa.Table.from_batches(tables)
        key = np.frombuffer(b"".join(t.column("key").to_pylist()), dtype=">u4").reshape(-1, DEPTH)
        tree, doc, size = (t.column(c).to_numpy() for c in ("tree", "doc", "size"))
        same = (key[1:] == key[:-1]) & (tree[1:] == tree[:-1])[:, None]
        lcp = np.cumprod(same, axis=1).sum(axis=1)
        left, right = [], []
        reach = lcp
        for s in range(1, NEIGHBOURS + 1):
            if s > 1:
                reach = np.minimum(reach[:-1], lcp[s - 1 :])
            at = np.flatnonzero(reach >= LEAST_DEPTH)
            left.append(at)
            right.append(at + s)
        for depth in RUN_DEPTHS:
            start = np.concatenate(([0], np.where(lcp >= depth, 0, np.arange(1, len(lcp) + 1))))
            start = np.maximum.accumulate(start)
            at = np.flatnonzero(start < np.arange(len(start)))
            left.append(start[at])
            right.append(at)
        left, right = np.concatenate(left), np.concatenate(right)
        fits = _size_fits(size[left], size[right]) & (doc[left] != doc[right])
        a, b = doc[left[fits]], doc[right[fits]]
        found, n = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0, return_counts=True) if len(a) else (np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64))
        yield batch_of(pairs, a=found[:, 0], b=found[:, 1], n=n)

    exploded = arrow_map(reps, spread, "tree int, key binary, doc long, size long")
    sorted_rows = exploded.repartitionByRange(partitions(reps.sparkSession), "tree", "key", "doc").sortWithinPartitions("tree", "key", "doc")
    return arrow_map(sorted_rows, meet, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _run_names(signs: list[bytes]) -> np.ndarray:
    """The run of each signature in each tree."""
    x = np.frombuffer(b"".join(signs), dtype=">u4").astype(np.uint64).reshape(-1, TREES, DEPTH)
    name = np.broadcast_to(mix(np.arange(1, TREES + 1, dtype=np.uint64)), x.shape[:2])
    for k in range(LEAST_DEPTH):
        name = mix(name * np.uint64(0x9FB21C651E98DF25) + x[:, :, k])
    return name.view(np.int64)


def run_members(reps: DataFrame) -> DataFrame:
    """(run, doc): the runs of LEAST_DEPTH equal min-hashes that each representative is in, one a tree."""
    schema = pa.schema([("run", pa.int64()), ("doc", pa.int64())])

    def run(batches):
        for b in batches:
            ids, signs = (b.column(c).to_pylist() for c in ("rep", "signature"))
            yield batch_of(schema, run=_run_names(signs).ravel(), doc=np.repeat(np.array(ids, dtype=np.int64), TREES))

    return arrow_map(reps, run, "run long, doc long")


def _dealt(rows: DataFrame, blocks) -> DataFrame:
    """Rows (run, doc, component and others) of runs that hold several components, once for each pair (i, j) of the run's
    blocks that their own block is in. blocks: an aggregate over a run."""
    live = rows.groupBy("run").agg(F.ceil(blocks).cast("int").alias("blocks"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    dealt = rows.join(live.select("run", "blocks"), "run").withColumn("block", F.expr("int(pmod(xxhash64(doc), blocks))"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")


def _in_cells(dealt: DataFrame, cell, schema: pa.Schema, cast: str) -> DataFrame:
    """cell(table) of all rows of a run and pair of blocks gives columns of a batch."""

    def meet(batches):
        held, cells = [], ("run", "i", "j")
        for b in chain(batches, (None,)):
            held += [b] if b is not None and b.num_rows else []
            if not held:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at = np.stack([t.column(c).to_numpy() for c in cells], axis=1)
            heads = np.append(np.flatnonzero(np.append(True, (at[1:] != at[:-1]).any(axis=1))), len(at))
            whole = len(heads) - 1 if b is None else len(heads) - 2
            for x, y in zip(heads[:whole], heads[1 : whole + 1], strict=True):
                found = cell(t.slice(x, y - x))
                if len(found["a"]):
                    yield batch_of(schema, **found)
            held = [] if b is None else t.slice(heads[whole]).to_batches()

    cells = dealt.repartition(partitions(dealt.sparkSession), "run", "i", "j").sortWithinPartitions("run", "i", "j")
    return arrow_map(cells, meet, cast)


def run_partners(members: DataFrame, reps: DataFrame, most: int | None) -> DataFrame:
    """(run, a, b): pairs of one run, of different components and LEAST_AGREE equal min-hashes; of each row in a cell the
    best most ones, or all. A pair comes from the first tree in which it shares a run: it would be found in the others
    again. members: run, doc, component; reps: rep, n_shingles, signature."""
    dealt = _dealt(members.select("run", "doc", "component"), F.count("*") / BLOCK_ROWS)
    dealt = dealt.join(reps.select(F.col("rep").alias("doc"), "n_shingles", "signature"), "doc")

    def cell(t: pa.Table):
        doc, component, size, block = (t.column(c).to_numpy() for c in ("doc", "component", "n_shingles", "block"))
        signs = t.column("signature").to_pylist()
        sign = np.frombuffer(b"".join(signs), dtype="<u4").reshape(len(doc), -1)
        heads = sign.reshape(len(doc), TREES, DEPTH)[:, :, :LEAST_DEPTH]
        run = t.column("run")[0].as_py()
        tree = int(np.flatnonzero(_run_names(signs[:1])[0] == run)[0])
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        out = []
        for k in range(len(doc)):
            fits = (component != component[k]) & _size_fits(size, size[k])
            if i != j:
                fits &= block != block[k]
            at = np.flatnonzero(fits)
            agree = (sign[at] == sign[k]).sum(axis=1)
            at, agree = at[agree >= LEAST_AGREE], agree[agree >= LEAST_AGREE]
            here = (heads[at] == heads[k]).all(axis=2).argmax(axis=1) == tree
            at, agree = at[here], agree[here]
            if most is not None:
                at = at[np.argsort(-agree, kind="stable")[:most]]
            out.append(np.stack([np.minimum(doc[at], doc[k]), np.maximum(doc[at], doc[k])], axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        return {"run": np.full(len(found), run), "a": found[:, 0], "b": found[:, 1]}

    schema = pa.schema([("run", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
    return _in_cells(dealt, cell, schema, "run long, a long, b long")


def run_pairs(members: DataFrame, reps: DataFrame, most: int | None) -> DataFrame:
    """(a, b) of run_partners()."""
    return run_partners(members, reps, most).select("a", "b")


def joining_links(component: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (places of two rows) that join all components that some pair of rows links. Every row meets all rows of other
    components, the smallest component's rows first; what it is linked with is one component from then on."""
    size = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    first = np.concatenate(([0], np.cumsum(size)))
    of = np.unique(component, return_inverse=True)[1]
    left, out = np.ones(len(sets), dtype=bool), []
    has = np.zeros(len(flat), dtype=bool)
    rows, starts, part = np.arange(len(sets)), first[:-1], flat
    while True:
        n = np.bincount(of[left], minlength=len(of))
        if np.count_nonzero(n) < 2:
            return out
        k = int(np.flatnonzero(left & (n[of] == n[n > 0].min()))[0])
        left[k] = False
        own = flat[first[k] : first[k + 1]]
        has[own] = True
        both = np.add.reduceat(has[part], starts, dtype=np.int64)
        has[own] = False
        linked = rows[left[rows] & (of[rows] != of[k]) & (100 * both >= SIMILAR * (size[rows] + size[k] - both))]
        joined, at = np.unique(of[linked], return_index=True)
        out += [(k, int(x)) for x in linked[at]]
        of[np.isin(of, joined)] = of[k]
        if 2 * np.count_nonzero(left) < len(rows):
            part = part[np.repeat(left[rows], size[rows])]
            rows = rows[left[rows]]
            starts = np.concatenate(([0], np.cumsum(size[rows])[:-1]))


def run_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links between rows of one run that join their components, on full sets. rows: run, doc, component,
    n_shingles; sets: rep, shingles, with each doc as a rep."""
    dealt = _dealt(rows, F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n_shingles") / BLOCK_SHINGLES))
    dealt = dealt.join(sets.select(F.col("rep").alias("doc"), "shingles"), "doc").select("run", "i", "j", "doc", "component", "shingles")

    def cell(t: pa.Table):
        doc, component = (t.column(c).to_numpy() for c in ("doc", "component"))
        column = t.column("shingles").combine_chunks()
        values, ends = column.flatten().to_numpy(), np.cumsum(pc.list_value_length(column).to_numpy())
        links = joining_links(component, np.split(values, ends[:-1]))
        return {"a": [doc[x] for x, _ in links], "b": [doc[y] for _, y in links]}

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    return _in_cells(dealt, cell, schema, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. All tables are written ones, so that a join on a rep with
    very many candidates is one that adaptive execution can split."""

    def sides(column: str) -> list[DataFrame]:
        return [sets.select(F.col("rep").alias(end), F.col(column).alias(f"of_{end}")) for end in "ab"]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def possible(batches):
        for b in batches:
            one, two = (b.column(c).to_pylist() for c in ("of_a", "of_b"))
            both = np.fromiter(map(most_shared, one, two), dtype=np.int64, count=len(one))
            size = np.fromiter(((len(x) + len(y)) // 2 for x, y in zip(one, two, strict=True)), dtype=np.int64, count=len(one))
            keep = np.flatnonzero(100 * both >= SIMILAR * (size - both))
            yield batch_of(schema, a=b.column("a").take(pa.array(keep)), b=b.column("b").take(pa.array(keep)))

    left, right = sides("short")
    near = saved(arrow_map(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b"), possible, "a long, b long"))
    release(pairs.sparkSession)
    left, right = sides("shingles")
    both = F.size(F.array_intersect("of_a", "of_b"))
    met = near.join(left, "a").join(right, "b").withColumn("both", both)
    out = saved(met.filter(100 * F.col("both") >= SIMILAR * (F.size("of_a") + F.size("of_b") - F.col("both"))).select("a", "b"))
    del near, met
    release(pairs.sparkSession)
    return out


_SET = ["n_shingles", "set_a", "set_b"]


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    texts = id_text(docs)
    sketch = saved(sketches(docs, width))
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    grouped = known.groupBy(*_SET).agg(F.min(F.struct("doc_id", "signature")).alias("least"))
    # a class of equal sets is a node by a number of its own: two classes may share their least doc_id
    classes = saved(grouped.select(*_SET, F.col("least.doc_id").alias("least_id"), F.col("least.signature").alias("signature"), F.monotonically_increasing_id().alias("rep")))
    reps = classes.select("rep", "n_shingles", "signature")
    spark = docs.sparkSession
    pairs = saved(candidate_pairs(reps))
    release(spark)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """rep, shingles, short; a repeated doc_id may have several texts, and the class's own is the one with its digest."""
        asked = classes.join(wanted, "rep", "left_semi").select("rep", "least_id", "set_a", "set_b")
        found = shingle_sets(texts.join(asked.select(F.col("least_id").alias("doc_id")).distinct(), "doc_id", "left_semi"), width)
        own = asked.join(found.withColumnRenamed("doc_id", "least_id"), ["least_id", "set_a", "set_b"])
        # the join's own keys among those that decide: its rows stay where they are
        out = saved(own.dropDuplicates(["least_id", "set_a", "set_b", "rep"]).select("rep", "shingles", "short"))
        del asked, found, own
        release(spark)
        return out

    wanted = saved(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    sets = sets_of(wanted)
    # first round: for either end, the partner met in most places
    ends = pairs.select(F.col("a").alias("end"), "a", "b", "n").unionByName(pairs.select(F.col("b").alias("end"), "a", "b", "n"))
    first = saved(ends.groupBy("end").agg(F.max(F.struct("n", "a", "b")).alias("top")).select("top.a", "top.b").distinct())
    now = saved(components(confirmed(first, sets)))
    # what is linked goes on as stars, so that components() has little left to do
    star = lambda found: found.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    rest = saved(pairs.join(first, ["a", "b"], "left_anti").select("a", "b"))
    del pairs, ends, first
    release(spark)
    members = run_members(reps)
    crowded = members.join(members.groupBy("run").count().filter("count > 1").select("run"), "run")
    placed = saved(crowded.join(now.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc")))
    del members, crowded
    release(spark)
    partners = saved(run_partners(placed, reps, 1))
    release(spark)
    if not partners.isEmpty():
        asked = partners.select("run", F.col("a").alias("doc")).unionByName(partners.select("run", F.col("b").alias("doc"))).distinct()
        rows = saved(asked.join(placed, ["run", "doc"]).join(reps.select(F.col("rep").alias("doc"), "n_shingles"), "doc"))
        new = saved(rows.select(F.col("doc").alias("rep")).distinct().join(wanted, "rep", "left_anti"))
        if not new.isEmpty():
            sets = sets.unionByName(sets_of(new))
        links = saved(run_links(rows, sets))
        del asked, rows, new
        release(spark)
        now = saved(components(saved(star(now).unionByName(links))))
    del placed, partners
    ca = now.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    cb = now.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    apart = saved(rest.join(ca, "a", "left").join(cb, "b", "left").filter("not (ca <=> cb) or ca is null").select("a", "b"))
    del rest, ca, cb
    release(spark)
    links = confirmed(apart, sets)
    if not links.isEmpty():
        now = saved(components(saved(star(now).unionByName(links))))
    del apart, sets, wanted
    release(spark)
    # doc_ids with several texts join the classes of all of them
    text_of = F.struct(*_SET)
    mixed = saved(sketch.filter("doc_id is not null").groupBy("doc_id").agg(F.min(text_of).alias("x"), F.max(text_of).alias("y")).filter("x <> y").select("doc_id"))
    several = not mixed.isEmpty()
    if several:
        held = saved(known.join(mixed, "doc_id", "left_semi").select("doc_id", *_SET).distinct().join(classes.select(*_SET, "rep"), _SET).select("doc_id", "rep"))
        same_id = held.join(held.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
        now = saved(components(saved(star(now).unionByName(same_id))))
    reach = now.select(F.col("node").alias("rep"), "component")
    placed = saved(classes.drop("signature").join(reach, "rep", "left").withColumn("component", F.coalesce("component", "rep")))
    of_class = placed.join(placed.groupBy("component").agg(F.min("least_id").alias("component_id")), "component").select("rep", *_SET, "component_id")
    if several:
        of_class = saved(of_class)
    out = sketch.drop("signature").join(of_class.drop("rep"), _SET, "left")
    component = F.coalesce("component_id", "doc_id")
    if several:
        of_id = held.join(of_class.select("rep", F.col("component_id").alias("of_id")), "rep").groupBy("doc_id").agg(F.min("of_id").alias("of_id"))
        out, component = out.join(of_id, "doc_id", "left"), F.coalesce("of_id", "component_id", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
