"""A corpus pipeline of the training-data operators. STAGES are applied in order to the documents.

Every stage but the last returns the columns of the documents that it keeps: language identification drops what it
rejects and fills in a missing lang, near-duplicate removal keeps the document of each group with the smallest doc_id,
passages that stand more than once are cut out of the texts (n_chars follows), documents that hold a benchmark item are
dropped, and the rest is packed into sequences of tokens. Every row is a document, also where its doc_id is null or another
row has it too. An empty table passes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm import common, decontamination, language_id, packing, repeats, simhash

#: Bytes of a passage that may not stand twice, and words of one that may not, even in fewer bytes: more than fifty.
REPEATED_BYTES = 250
REPEATED_WORDS = 51


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    model = language_id.fit(docs.where(~language_id.held_out()))
    marked = language_id.predict(docs, model, docs.columns, ("__lang", "__score", "__rejected"))
    return marked.where("not __rejected").withColumn("lang", F.coalesce("lang", "__lang")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are documents of their own, whatever their doc_id: each group keeps exactly one of its rows."""
    common.bound_batches(spark)
    return simhash.one_of_each(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return repeats.without_repeats(docs, REPEATED_BYTES, REPEATED_WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = common.table(spark, sf_dir, "benchmark")
    return decontamination.clean(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.bound_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]

#: Classification, fingerprints, edit distances and packing are beyond SQL; the tests hold the stages against slow versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
