"""The corpus pipeline: toxicity, quality rules, near-duplicates, packing, each on all that its predecessor kept."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import packing, quality, simhash, toxicity
from folioforge.llm.common import shared_dir, table, written_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on `labels`, does not reject.

    Null and empty texts are clean and stay, so do rows with a null id; repeated rows are judged alike; an empty table stays
    empty. Every stage but the last returns COLUMNS: other columns of `docs` are left out.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the certified cutoffs of their language keep.

    Null and empty texts have no words and go; null languages are a stratum of their own; null ids and repeated rows stand for
    themselves; an empty table stays empty.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts at a similarity of 0.8 of their five-word shingles: the one with the smallest id.

    Texts without words are alike (see simhash.keep_one); rows with a null id stay, nothing names them; rows repeated under one id leave one for
    each group among them; an empty table stays empty.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; see packing.pack.

    A null text is empty and has one piece, its end mark; each row is packed for itself, ids may be null or repeat; an empty
    table has no pieces.
    """
    return packing.pack(docs, path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_low_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack_sequences)]
#: Learned scores, fingerprints and token ids are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again; what a stage wrote goes once the next one is stored."""
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/folioforge/{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with written_tables(spark):  # a stage's own tables go once its result is stored
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
        if before:
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{before}")
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        before = name
    return docs
