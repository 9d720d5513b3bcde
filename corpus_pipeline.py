"""A training-data pipeline over `documents`: each stage takes what its predecessor kept.

toxicity: documents that the factorization machine scores THRESHOLD or more go. near_duplicates: of each group of
documents whose five-word shingles are alike by 0.8 or more, the least doc_id stays. decontamination: documents whose
tiles cover half of a benchmark item go. personal_data: spans are replaced by their kind, n_chars follows the text.
encode: ids of each text, checked by decoding them.

Null texts count as empty and stay null until personal_data; rows with a null doc_id stay; repeated doc_ids stay or go
together; a table without rows passes as such. Other columns of the table pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rill.llm import bpe, decontam, minhash_forest, pii, toxicity
from rill.llm.common import KERNEL_BYTES, documents, drop_folder, fresh_folder
from rill.llm.queries import tokenizer

#: SQL can't express a trained model, banded sketches, tilings or a tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def _pieces(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) in pieces of about KERNEL_BYTES."""
    raw = [b"" if t is None else t.encode() for t in texts]
    at, size = 0, 0
    for k, t in enumerate(raw):
        if size and size + len(t) > KERNEL_BYTES:
            yield at, raw[at:k]
            at, size = k, 0
        size += len(t)
    if raw:
        yield at, raw[at:]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    spread = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        fm = spread.value
        out = [fm.score(*toxicity.terms_of(raw)) for _, raw in _pieces(texts)]
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.filter(score("text") < toxicity.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = minhash_forest.near_duplicates(docs, width=5)
    gone = groups.filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:

    def holds(spread):
        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            hit = np.zeros(len(texts), dtype=bool)
            for at, raw in _pieces(texts):
                for d, *_ in decontam.found(spread.value, raw):
                    hit[at + d] = True
            return pd.Series(hit)

        return run("text")

    out = docs
    for block in decontam.item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        out = out.filter(~holds(spark.sparkContext.broadcast(decontam.SeedIndex(block, decontam.COVERAGE))))
    return out


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    accept = pii.accepted_patterns(docs)
    masked = pii.masked_text(docs, accept, docs.columns)
    return masked.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = bpe.bpe_round_trip(docs, tokenizer("byte_bpe_50k.json"))
    return ids.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder, before = fresh_folder(spark, "pipeline"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
