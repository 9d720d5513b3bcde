"""Operator 7: personal data by weakly supervised span labelling.

Base spans follow fixed patterns and always stay. Beyond them, candidate spans (long unbroken runs of letters and
digits) are judged by labellers: shapes, a gazetteer of key words before the span, and its context (assignment signs,
quotes). Expectation-maximisation over the counts of vote patterns estimates how reliable each labeller is; the
posteriors train a linear span classifier on the candidates' features; what it accepts is added as kind ``secret``.

The counts are taken over all documents, but only by vote and feature pattern, so what reaches the driver is bounded by
the number of patterns, whatever the input. Two passes over the texts, no shuffle but that of the counts.

Defined cases: null or empty text has no spans; repeated or null doc_ids are rows like any other; of overlapping
candidates a base span wins; without any candidate nothing is learned and only base spans are returned.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, id_text, pieces

BASE_KINDS = ("email", "ip", "card", "phone")
EM_ROUNDS, FIT_ROUNDS, ACCEPT = 50, 300, 0.5
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[A-Za-z0-9_+/-]{16,}")
#: Gazetteer of words that stand before a credential.
KEY_WORDS = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "access_key", "private_key", "credential", "bearer", "auth", "key")
_KEY_BEFORE = re.compile(r"(?:" + "|".join(KEY_WORDS) + r")[\"']?\s{0,2}[=:]?\s{0,2}[\"']?\Z", re.I)
_SIGN_BEFORE = re.compile(r"[=:]\s{0,2}[\"']?\Z")
_HEX = re.compile(r"[0-9a-fA-F]{32,}\Z")


def emails(text: str) -> list[tuple[int, int]]:
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_SET:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", max(last, at + 1))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Every four parts of a run of dotted numbers are one match."""
    out = []
    for run in _DOTTED.finditer(text):
        at, parts = run.start(), run.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(ch for ch in s if "0" <= ch <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind, find in zip(BASE_KINDS, (emails, ips, cards, phones), strict=True) for a, b in find(text)]


def _candidates(text: str):
    """(start, end, votes, features): votes 2 bits a labeller (1 against, 2 for, 0 none); features one bit each."""
    for m in _CANDIDATE.finditer(text):
        s, a, b = m.group(), *m.span()
        digits, uppers = sum(map(str.isdigit, s)), sum(map(str.isupper, s))
        lowers = len(s) - digits - uppers
        before, after = text[max(0, a - 24) : a], text[b : b + 1]
        hexed, mixed = bool(_HEX.match(s)), digits > 2 and uppers + lowers > 2
        spread = len(set(s)) >= 10
        key, sign = bool(_KEY_BEFORE.search(before)), bool(_SIGN_BEFORE.search(before))
        quoted = before[-1:] in ("'", '"') and after == before[-1:]
        votes = (
            2 if hexed and mixed else 1 if not digits else 0,  # shape: a long hexadecimal number
            2 if mixed and spread else 1 if not mixed else 0,  # shape: letters and digits well mixed
            2 if key else 0,  # gazetteer
            2 if sign else 1 if before[-1:] == " " else 0,  # context: assigned
            2 if quoted else 0,  # context: quoted
        )
        bits = (hexed, mixed, spread, key, sign, quoted, len(s) >= 24, len(s) >= 40, digits == 0, digits * 4 > len(s), uppers > 0 and lowers > 0, "-" in s or "/" in s)
        yield a, b, sum(v << 2 * k for k, v in enumerate(votes)), sum(bool(x) << k for k, x in enumerate(bits))


N_LABELLERS, N_FEATURES = 5, 12


def pattern_counts(docs: DataFrame) -> list[tuple[int, int, int]]:
    """(votes, features, count) over all candidates of all documents; at most as many rows as patterns exist."""
    schema = pa.schema([("votes", pa.int32()), ("features", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for b in pieces(batches):
            seen: dict[tuple[int, int], int] = {}
            for t in b.column("text").to_pylist():
                for _, _, v, f in _candidates(t):
                    seen[v, f] = seen.get((v, f), 0) + 1
            if seen:
                yield batch_of(schema, votes=[k[0] for k in seen], features=[k[1] for k in seen], n=list(seen.values()))

    counts = arrow_map(id_text(docs), run, "votes int, features int, n long").groupBy("votes", "features").agg(F.sum("n").alias("n"))
    return sorted((r.votes, r.features, r.n) for r in counts.collect())


def estimate(counts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each pattern, and per labeller P(vote | class), by expectation-maximisation."""
    votes = np.array([[v >> 2 * k & 3 for k in range(N_LABELLERS)] for v, _, _ in counts])
    n = np.array([c for _, _, c in counts], dtype=float)
    one = np.eye(3)[votes]
    post = np.clip(((votes == 2).sum(1) + 0.5) / ((votes > 0).sum(1) + 1.0), 0.02, 0.98)
    for _ in range(EM_ROUNDS):
        weight = np.stack([n * (1 - post), n * post])
        table = np.einsum("ci,ikv->ckv", weight, one) + 0.1
        table /= table.sum(-1, keepdims=True)
        prior = (weight.sum(1) + 1) / (n.sum() + 2)
        score = np.log(prior)[:, None] + np.einsum("ikv,ckv->ci", one, np.log(table))
        post = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
    return post, table


def fit(counts: list[tuple[int, int, int]]) -> np.ndarray:
    """Weights of the span classifier, the last one the bias."""
    if not counts:
        return np.append(np.zeros(N_FEATURES), -10.0)
    post, _ = estimate(counts)
    x = np.array([[f >> k & 1 for k in range(N_FEATURES)] + [1] for _, f, _ in counts], dtype=float)
    n = np.sqrt(np.array([c for _, _, c in counts], dtype=float))
    w = np.zeros(N_FEATURES + 1)
    for _ in range(FIT_ROUNDS):  # Newton's steps would do with fewer; these can't diverge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 2.0 * (x.T @ (n * (post - p)) / n.sum() - 1e-4 * w)
    return w


def accepted(weights: np.ndarray, features: int) -> bool:
    bits = np.array([features >> k & 1 for k in range(N_FEATURES)] + [1], dtype=float)
    return bool(1 / (1 + np.exp(-float(bits @ weights))) >= ACCEPT)


def all_spans(text: str, accept: frozenset[int]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, base spans and then added ones). accept: feature patterns that the classifier accepts."""
    base = base_spans(text)
    by_start, at = sorted((x, y) for _, x, y in base), 0
    reach, extra = 0, []  # the greatest end of the base spans that begin before the candidate's end
    for a, b, _, f in _candidates(text):
        while at < len(by_start) and by_start[at][0] < b:
            reach = max(reach, by_start[at][1])
            at += 1
        if f in accept and reach <= a:
            extra.append(("secret", a, b))
    return base, base + extra


def accepted_patterns(docs: DataFrame) -> frozenset[int]:
    counts = pattern_counts(docs)
    weights = fit(counts)
    return frozenset(f for f in {f for _, f, _ in counts} if accepted(weights, f))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_secret."""
    accept = accepted_patterns(docs)
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_secret"]
    schema = pa.schema([(c, pa.string() if c in ("base_sha256", "spans") else pa.int64()) for c in names])

    def run(batches):
        for b in pieces(batches):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                base, every = all_spans(text, accept)
                rows.append((doc, *(sum(s[0] == k for s in base) for k in BASE_KINDS), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base)))
            if rows:
                yield batch_of(schema, **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))

    return arrow_map(id_text(docs), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long")


def mask(text: str, accept: frozenset[int]) -> str:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    spans = sorted((a, b, k) for k, a, b in all_spans(text, accept)[1])
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked_text(texts: DataFrame, accept: frozenset[int], columns: list[str]) -> DataFrame:
    """texts with its text column masked; the other columns pass through. A null text stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else mask(t, accept))

    return texts.withColumn("text", run("text")).select(*columns)
