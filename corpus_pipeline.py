"""A corpus from raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of ``documents``;
columns that ``docs`` has besides pass through them. A table without rows passes all stages and stays empty.
A stage has its session send texts to Python in small batches, unless the session sets their size itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import column, set_aside
from tidemark.llm.decontaminate import WINDOW, remove_contaminated
from tidemark.llm.jaccard import one_of_each
from tidemark.llm.merge_encoding import encode_checked
from tidemark.llm.quality import learn_quality, score_quality
from tidemark.llm.secrets import redact_secrets
from tidemark.session import small_batches, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, scores 0.5 or more; null texts are scored as empty ones."""
    small_batches(spark)
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    named, back = set_aside(docs, ("score", "predicted"))
    kept = score_quality(named, model).where(F.col("predicted") == 1).drop("score", "predicted")
    return kept.withColumnsRenamed(back).select(*[column(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by a similarity of 0.8 or more over runs of five words."""
    small_batches(spark)
    return one_of_each(docs)


def recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where it is there and not null, as the length of the text."""
    if "n_chars" not in docs.columns:
        return docs
    counted = F.length("text").cast(docs.schema["n_chars"].dataType)
    return docs.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.coalesce(counted, F.col("n_chars"))))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in windows of benchmark items, without these passages.

    Passages of ``WINDOW`` words or more are cut out; what holds none stays as it is. ``n_chars`` is counted anew where it was.
    """
    small_batches(spark)
    return recounted(remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), longest=WINDOW - 1))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by a mask and ``n_chars`` counted anew where it was."""
    small_batches(spark)
    return recounted(redact_secrets(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and the hash of the text decoded from them, in place of the text."""
    small_batches(spark)
    return encode_checked(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("encoding", encoding),
]

#: The classifier is fitted and the encoding merges pieces, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
