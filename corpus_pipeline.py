"""A corpus pipeline of five operators, each stage on all that the one before it kept.

Language ID (rejected documents go), SimHash near-duplicates (one document of each group stays),
benchmark decontamination (documents that hold an item go), secret scans (secrets are masked in
the text) and mixing of sources (documents that the mix takes nothing of go; the others keep their columns and tell how
many of their words it takes).

In every stage null texts are empty, columns of any name and type keep their values, an empty table stays empty, and
each stage says what it does with ties and repeated rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import langid, lsa, mixing, secrets, simhash
from stratagraph.llm.common import remainder, written

#: A prediction below this posterior probability is rejected, like texts of no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a language. The decision is a function of the row's text, so it is made
    beside the row, without a join. Texts without letters have none and go; repeated rows stay or go alike."""
    model = langid.fit(docs.where(remainder("doc_id", 5) != 0), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.keep(docs, model, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the smallest id, of equal ids the smallest text; of
    repeated rows one. Texts without words are one component."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Texts without words hold none; repeated rows stay or go alike; without a
    benchmark all stay."""
    return lsa.keep(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the text, and keeps every document. Repeated rows are masked alike."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with ``taken_words``. Texts without words are never taken; repeated rows are
    documents of their own; a null source is a source."""
    return mixing.keep(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", mask_secrets),
    ("mixing sources to target weights", mix),
]

#: Fitted models and fingerprint components are not to be had in SQL; the stages are tested instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}", docs)
    return docs
