"""A corpus made ready for training: five stages over the documents, each written before the next reads it.

Each stage works on all rows that its predecessor kept and learns from these rows only. All but the last return the
columns of documents, extra ones too. Documents without text or letters go in the first stage, long ones are read whole.
Where keys repeat or lack, the stages that join their decisions back give every row a number of its own: texts under one
key, or none, are compared and taken like all others, and of equal texts the smallest key (or number) stays.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.llm import langid, mixing, neardup, packing, quality
from tallyveil.llm.common import new_name, shared_folder, with_own_key

#: A document whose best language knows less of its n-grams is in none of the learned languages.
LEAST_KNOWN = 0.2
#: Documents of a lower quality score go.
LEAST_QUALITY = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    rows = langid.identify(docs, langid.train(docs))
    return rows.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_known") >= LEAST_KNOWN)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    rows = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.filter(F.col("quality_score") >= LEAST_QUALITY).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    rows, key = with_own_key(docs, "doc_id")
    kept = neardup.near_duplicates(rows.select(key, "text"), key=key).filter("kept").select(key)
    return rows.join(kept, key, "left_semi").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    rows, key = with_own_key(docs, "doc_id")
    taken = mixing.mix(rows.select(key, "text", "source"), key=key).filter("copies > 0").select(key, "copies")
    each = new_name(rows)
    copies = F.explode(F.sequence(F.lit(1), F.col(each).cast("int"))).alias(each)
    return rows.join(taken.withColumnRenamed("copies", each), key).select(*docs.columns, copies).drop(each)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("quality", good), ("near-duplicates", distinct), ("mix", mixed), ("packing", packed)]

#: SQL can express neither the classifiers nor the draws; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
