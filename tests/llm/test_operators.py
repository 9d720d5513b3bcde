"""The ten text operators and the pipeline against brute-force versions, with empty, null, repeated and odd rows."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from rill.llm import blocks, bpe, compact_windows, decontam, fingerprint, minhash_forest, pii, quality, queries, suffix_dedup, token_planes, toxicity

SF = "/root/testdata/sf0.001"
ODD = [(900001, None, "x"), (900002, "", "y"), (900003, " \n\t ", "z"), (900004, "one", "w"), (900005, "one", "w"), (None, "lost words here", "v"), (900006, "a" * 5000, "u"), (900007, "ab " * 3000, "t"), (900007, "ab " * 3000, "t")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    return real.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, source string")).cache()


@pytest.fixture(scope="module")
def table(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_fingerprint(docs, table, empty):
    got = fingerprint.edited_likeness(docs).collect()
    assert len(got) == len(table) and fingerprint.edited_likeness(empty).count() == 0
    ids = collections.Counter(d for d, _ in table)
    rows = sorted((t for t in table if t[0] is not None and ids[t[0]] == 1), key=lambda t: t[0])
    by = {r.doc_id: r for r in got}
    for (d, t), (d2, u) in zip(rows, rows[1:], strict=False):
        if d2 == d + 1 or d2 < 900000:
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            r = by[d]
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
            assert r.fingerprint == fingerprint.fingerprint(t) and r.edited_fingerprint == fingerprint.fingerprint(edited)
            assert r.near_next == fingerprint.likeness(r.fingerprint, fingerprint.fingerprint(u))
    assert fingerprint.likeness(fingerprint.fingerprint(""), fingerprint.fingerprint("")) == 1.0


def test_fingerprint_in_segments(monkeypatch):
    text = "".join(random.Random(1).choices("abcdefgh ", k=5000))
    whole = fingerprint.fingerprint(text)
    monkeypatch.setattr(fingerprint, "SEGMENT", 700)
    assert fingerprint.fingerprint(text) == whole


def test_edit_distance():
    draw = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ("".join(draw.choices("abc", k=draw.randint(0, 30))) for _ in range(2))
        assert fingerprint.edit_distance(a, b) == plain(a, b)


def brute_removed(rows, length):
    seen = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = collections.Counter()
    for d, t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out[d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [40, 200])
def test_suffix_dedup(spark, monkeypatch, empty, length):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    draw = random.Random(5)
    base = ["".join(draw.choices("abc d", k=draw.randint(1, 400))) for _ in range(12)]
    rows = []
    for k in range(60):
        parts = []
        for _ in range(draw.randint(0, 4)):
            b = draw.choice(base)
            parts.append(b[draw.randint(0, len(b) - 1) :][: draw.randint(0, 300)] + draw.choice(["", "x", "é", "a" * draw.randint(0, 500)]))
        rows.append((k, "".join(parts)))
    rows += [(100, None), (100, ""), (None, "abab" * 300), (101, "abab" * 300), (102, "z" * 199), (103, "z" * 200)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_removed([(d, (t or "").encode()) for d, t in rows], length)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, table, empty, width):
    sets = {}
    for d, t in table:
        w = words(t)
        sets[d] = {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(d for d in sets if d is not None)
    least = {d: d for d in ids}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                least[max(x, y)] = min(x, y)
    for r in minhash_forest.near_duplicates(docs, width).collect():
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (find(r.doc_id), find(r.doc_id) == r.doc_id))
    assert minhash_forest.near_duplicates(empty, width).count() == 0


def test_quality(spark, docs, table, empty):
    got = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert len(got) == len({d for d, _ in table}) and quality.quality(empty).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    right = [got[r.doc_id].kept == bool(r.quality) for r in labels if r.doc_id in got]
    assert sum(right) >= 0.85 * len(right)


def test_token_planes(docs, table, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = sorted(token_planes.token_files(docs, path).collect(), key=lambda r: r.start)
    assert token_planes.token_files(empty, path).count() == 0
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(d for d, _ in table if d is not None)
    texts, start = dict(table), 0
    for r in got:
        ids = np.array([*lib.encode(texts[r.doc_id], add_special_tokens=False).ids, 2], dtype="<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@pytest.mark.parametrize("bits", [False, True])
def test_plane_files(bits):
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 5000, 1)]
    f = io.BytesIO()
    w = token_planes.PlaneWriter(f, bits, chunk=1000)
    for k, x in enumerate(ids):
        w.add(k or None, x)
    w.close()
    back = token_planes.PlaneReader(f, len(f.getvalue()))
    assert list(back.documents()) == list(zip([None, 1, 2, 3], ids, strict=True)) and len(back.index) == 6
    with pytest.raises(ValueError):
        token_planes.PlaneReader(io.BytesIO(f.getvalue()[:-3]), len(f.getvalue()) - 3)


PARTS = [" ", "  ", "\n", "a", "b", "'s", "'ll", "é", "ß", "Ä", "<|endoftext|>", "<|endof", "１", "9", "!", " ", "\x1c", "\t", "😀", "́", "the", "\x85", "中", "​", "İ", "Σ", "\x0b", "<|startoftext|>", " I", "_", "Word,"]


def test_encoders_like_the_library():
    from tokenizers import Tokenizer

    own, lib = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json")), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    cached, words_lib = token_planes.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(1)
    for _ in range(4000):
        s = "".join(draw.choices(PARTS, k=draw.randint(0, 14)))
        ids = lib.encode(s, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(s), dtype="<u4").tolist() == ids
        assert own.decode(own.encode(s)) == lib.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(cached([s.encode()])[0], dtype="<u4").tolist() == words_lib.encode(s, add_special_tokens=False).ids


def test_bpe_digests(docs, table, empty):
    got = bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == collections.Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in table)
    assert bpe.bpe_digests(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def brute_spans(t):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in patterns.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_personal_data(docs, table, empty):
    draw = random.Random(3)
    parts = ["a", "@", ".", "-", "1", "2", "25", ".com", "+", "+1", " ", "(", ")", "x@y.z", "1.2.3.4", "4111", "1111", "999", "%", "é"]
    for _ in range(10000):
        s = "".join(draw.choices(parts, k=draw.randint(0, 25)))
        assert pii.base_spans(s) == brute_spans(s)
    got = pii.find_personal(docs).collect()
    texts = dict(table)
    for r in got:
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)
        assert all(f"secret:{m.start(1)}:{m.end(1)}" in r.spans for m in re.finditer(r'token = "([0-9a-f]{40})"', texts[r.doc_id]))
    assert len(got) == len(table) and pii.find_personal(empty).count() == 0
    assert pii.mask("write to a.b@c.de or +1 (555) 123-4567", frozenset()) == "write to <email> or <phone>"


def test_decontamination(spark, empty):
    item = " ".join(f"w{k}" for k in range(40))
    w = item.split()
    moved = " ".join(["x"] * 9 + w[20:40] + ["y"] * 5 + w[:20])
    docs = spark.createDataFrame([(1, moved), (2, " ".join(w[:12])), (3, None), (4, "W0 " + " ".join(w[1:])), (5, "short one"), (5, "short one")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, ""), (9, None), (10, "short one")], "item_id long, text string")
    for most in (10, 10**6):
        got = sorted((r.doc_id, r.item_id, r.coverage, r.n_tiles) for r in decontam.contaminated(docs, items, most_words=most).collect())
        assert got == [(1, 7, 1.0, 2), (4, 7, 1.0, 1), (5, 10, 1.0, 1), (5, 10, 1.0, 1)]
    assert decontam.contaminated(empty, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_compact_windows_are_cartesian_nodes():
    draw = random.Random(2)
    for _ in range(100):
        texts = [np.array([draw.randint(1, 30) for _ in range(draw.randint(0, 40))], dtype=np.uint64) for _ in range(3)]
        first, tokens, least = np.concatenate(([0], np.cumsum([len(d) for d in texts]))), np.concatenate(texts), draw.randint(2, 7)
        got = set(zip(*(x.tolist() for x in compact_windows.windows(tokens, first, 1, least)[:4]), strict=True))
        v = compact_windows.mix(tokens + np.uint64(0x9E3779B97F4A7C15))
        want = set()
        for d in range(3):
            x = [(int(v[i]) >> 26, i) for i in range(first[d], first[d + 1])]
            for c in range(len(x)):
                low = high = c
                while low > 0 and x[low - 1] > x[c]:
                    low -= 1
                while high + 1 < len(x) and x[high + 1] > x[c]:
                    high += 1
                if high - low + 1 >= least:
                    want.add((d, low, c, high))
        assert got == want


def test_repeated_passages(docs, table, empty):
    got = compact_windows.repeated_passages(docs).collect()
    tokens = {d: words(t) for d, t in table if d is not None}
    seen = collections.defaultdict(set)
    for d, w in tokens.items():
        for i in range(len(w) - 50):
            seen[tuple(w[i : i + 51])].add(d)
    shared = set().union(*(s for s in seen.values() if len(s) > 1))
    assert shared <= {r.doc_id for r in got} | {r.rep_id for r in got}
    for r in got:
        a, b = (({tuple(w[i : i + 5]) for i in range(x, y - 4)}) for w, x, y in ((tokens[r.doc_id], r.start_word, r.end_word), (tokens[r.rep_id], r.rep_start_word, r.rep_end_word)))
        assert len(a & b) / len(a | b) == pytest.approx(r.similarity) and r.similarity >= 0.8 and r.rep_id < r.doc_id
    assert compact_windows.repeated_passages(empty).count() == 0


def test_toxicity_learns_pairs(spark, empty):
    draw = random.Random(4)
    rows, labels = [], []
    for k in range(1200):
        insult, group = draw.random() < 0.4, draw.random() < 0.4
        rows.append((k, " ".join([*draw.choices(["aa", "bb", "cc", "dd", "ee"], k=12), *["nasty"] * insult, *["folk"] * group])))
        labels.append((k, int(insult and group)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    got = toxicity.toxicity(docs, spark.createDataFrame([*labels, (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")).collect()
    want = dict(labels)
    out = [r for r in got if r.doc_id in want and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == 1202
    assert sum(r.predicted == want[r.doc_id] for r in out) >= 0.97 * len(out)
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "encode":
            assert out.columns == docs.columns
        docs = out.cache()
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] == seen[-2] == queries.queries()["pipeline"](spark, SF).count()


def test_stretches_of_many_groups():
    rng = np.random.default_rng(5)
    group = np.sort(rng.integers(0, 40, 600))
    fn, low = rng.integers(0, compact_windows.HASHES, 600), rng.integers(0, 60, 600)
    high = low + rng.integers(0, 30, 600)
    want = []
    for g in np.unique(group):
        mine = group == g
        on = [len(set(fn[mine & (low <= x) & (high >= x)])) >= 3 for x in range(100)]
        starts = [x for x in range(100) if on[x] and not (x and on[x - 1])]
        want += [(g, x, next(y for y in range(x, 100) if not on[y]) - 1) for x in starts]
    assert [tuple(r) for r in zip(*compact_windows.stretches(group, fn, low, high, 3), strict=True)] == want


@pytest.mark.parametrize("n", [50, 300])
def test_hub_in_a_crowded_run(spark, n):
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**9)}" for _ in range(400)]

    def copy():
        out = list(base)
        for k in rng.sample(range(5, 390, 7), 6):
            out[k] = f"x{rng.randrange(10**9)}"
        return out

    rows = [(k, " ".join(base if k == n // 2 else copy())) for k in range(n)]
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert {r.component_id for r in got} == {0}


@pytest.mark.parametrize("edits", [1, 2])
@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_aligned_keeps_edited_passages(edits, kind):
    draw, held = random.Random(edits), 0
    word = lambda: f"w{draw.randrange(10**9)}"
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    tokens = lambda w: compact_windows._tokens([" ".join(w).encode()])[0]
    for n in range(49, 130):
        one = [word() for _ in range(n)]
        two = list(one)
        for k in sorted(draw.sample(range(6, n - 6), edits), reverse=True):
            two[k : k + (kind != "insert")] = [] if kind == "delete" else [word()]
        a, b = sets(one), sets(two)
        if len(two) < 48 or len(a & b) < 0.8 * len(a | b):
            continue
        held += 1
        around = [[word() for _ in range(15)] for _ in range(4)]
        got = compact_windows.aligned(tokens(around[0] + two + around[1]), tokens(around[2] + one + around[3]), 44, 0.8)
        assert [(x, y) for x, y, *_ in got] == [(15, 15 + len(two) - 5)] and got[0][4] == pytest.approx(len(a & b) / len(a | b))
    assert held > 20
