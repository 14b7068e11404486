"""Pipeline over documents: four stages, each written as Parquet and read again as the next one's input."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from pisoval.llm import sentence_pieces, toxicity
from pisoval.llm.mixing import mixed_rows
from pisoval.llm.near_text import near_duplicates, with_text_key
from pisoval.session import checkpoint_dir


def _own_name(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below 0.5. Null and empty texts stay; labels teach, and decide nothing by themselves."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the smallest doc_id, and of rows that repeat it with the same text, one."""
    key, kept = _own_name(docs, "text_key"), near_duplicates(docs).where("kept").select(F.col("id").alias("kept_id"), F.col("text_key").alias("kept_key")).distinct()
    keyed = with_text_key(docs, "doc_id", "text", key)
    same = keyed["doc_id"].cast("long").eqNullSafe(kept["kept_id"]) & (keyed[key] == kept["kept_key"])
    return keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", key]).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, dealt out to 16 shards and shuffled inside."""
    return mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its piece ids and their number."""
    encoded = sentence_pieces.encode(docs)
    return encoded.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [("drop_toxic", drop_toxic), ("near_dedup", near_dedup), ("mix", mix), ("tokenize", tokenize)]

#: No SQL expresses the learned and sketching stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents. What a stage leaves lies in the session's shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{number}-{name}")
        docs = spark.read.parquet(path)
    return docs
