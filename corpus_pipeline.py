"""A training corpus from ``documents``: toxic documents go, near copies go, repeated passages go, sources are mixed to
target weights, and the texts left are encoded. Each stage is written as Parquet and read again by the next one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, common, mixing, simhash, suffixdedup, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the threshold of their language stay; the classifier learns from the labels given."""
    model = toxicity.fit(docs, common.read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(~F.col("rejected")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (a Jaccard of 0.8 or more of five-word shingles) the document of the smallest id stays.
    Different texts under one id are judged each on its own. Rows of a null id stay; of rows that are equal one stays."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a document of smaller id has; characters that are cut in two go."""
    found = suffixdedup.removals(docs.select(*COLUMNS), as_text=True).select("doc_id", F.col("kept").alias("text"), "lang", "source")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens, dealt by the weights of domain, language and source; no document twice, so a leaf that has less
    than its share gives all it has and the others share the rest."""
    return mixing.mix(docs, share=0.8, weights=mixing.WEIGHTS, max_epochs=1, domain=F.expr(mixing.DOMAIN)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids, decoded): the ids as little-endian unsigned 32-bit integers, and their text."""
    path = bpe.vocabulary_path()
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, decoded="decoded")
    return ids.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: A classifier, fingerprints and BPE are beyond SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage wrote; what the others wrote is removed once the next one has."""
    docs = common.read(spark, sf_dir, "documents")
    folder, before = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        if before:
            common.remove(spark, before)
        before = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(before)
    return docs
