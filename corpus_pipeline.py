"""From raw documents to packed training sequences, by five of the library's operators.

Each stage takes (spark, docs, sf_dir) and works on every row it is given; its
result is written and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewatch.llm import mixing, packing, pii, quality, simhash
from casewatch.llm.common import id_remainder, removed, shared_folder, table
from casewatch.llm.queries import FOLDS, WEIGHTS, domain

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more; it learns from the labels of the documents given.

    Null and empty texts have the score of a text without features and stay or go
    together; repeated rows and ids are scored each by itself. Without labels all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_remainder(F.col("doc_id"), FOLDS) != 0)
    return quality.score(docs, model).where("score >= 0.3").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with 0.8 or more of their five-word shingles in common: that with the least id.

    Null and empty texts are one group. Rows without an id come after all others
    of their group and stay where they have none; of rows that repeat id and
    text one stays, rows with one id and different texts are different documents.
    """
    return simhash.survivors(docs).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what gives it away taken out of their texts; n_chars follows.

    Null texts stay null and have a null n_chars, empty ones stay empty; repeated rows stay.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the target weights, once for each epoch they are used in.

    Documents without words go. Null languages and sources are leaves of their
    own, ties in the order are broken by id and text, repeated rows count each.
    """
    return mixing.mix(docs, domain(), WEIGHTS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row for each piece of a document in each bin.

    Null and empty texts take the place of a separator; repeated rows are packed each.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicates", without_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first stage learns a model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, by way of the shared checkpoint folder; what stages hand on is removed."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            removed(spark, [f"{folder}/{k - 1}"])
    return docs
