"""Continuous valuation of listings that arrive as JSON lines.

An epoch's rows are written to a folder of their own attempt; only when they are complete, one line of a commit log names that folder.
Readers take the folders that the log names and no others, so an epoch in work, or one that broke off, is never seen. An epoch
that the log names is not valued again.
"""
from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.batch import ONCE, errors, results, value_batch, write_outcome
from ..session import drop_folder, folders_in, path_exists
from ..sources.listings import lines_of, raw_lines
from ..sources.reference import References

LOG_SCHEMA = "epoch long, folder string, columns string"


def _log(output: str) -> str:
    return f"{output}/commits"


def committed(spark: SparkSession, output: str) -> DataFrame:
    """(epoch, folder, columns) of every committed epoch; folders are relative to the output."""
    if not path_exists(spark, _log(output)):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).json(_log(output))


def value_micro_batch(lines: DataFrame, epoch: int, refs: References, output: str) -> None:
    """Value one micro-batch, then commit it; an epoch that was committed before is left as it is.

    Batches come from the data: a line that holds an envelope or an array is a request of its own, and bare listings of one
    file form a batch, in which copies of a code count.  How many files a trigger takes changes nothing.
    """
    spark = lines.sparkSession
    if committed(spark, output).where(f"epoch = {int(epoch)}").limit(1).count():
        return
    outcome = value_batch(raw_lines(lines), refs)
    folder = f"data/epoch={epoch}/attempt={uuid.uuid4().hex}"
    write_outcome(outcome, f"{output}/{folder}")
    spark.createDataFrame([(epoch, folder, outcome.drop(ONCE).schema.json())], LOG_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{_log(output)}/epoch-{epoch}")


def value_stream(spark: SparkSession, source: str, refs: References, output: str, checkpoint: str,
                 available_now: bool = True, max_files: int = 1000) -> StreamingQuery:
    """Start the stream; `read_stream_output` gives its results and errors."""
    lines = lines_of(spark.readStream.option("maxFilesPerTrigger", max_files).text(source))
    writer = (lines.writeStream.option("checkpointLocation", checkpoint)
              .foreachBatch(lambda df, epoch: value_micro_batch(df, epoch, refs, output)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_stream_output(spark: SparkSession, output: str, refs: References) -> tuple[DataFrame, DataFrame]:
    """(results, errors) of the epochs committed so far."""
    log = committed(spark, output).orderBy("epoch").collect()
    if not log:
        empty = value_batch(spark.sql("SELECT '' AS batch_id, 0L AS row_id, parse_json('null') AS raw WHERE false"), refs)
        return results(empty, refs.meta), errors(empty)
    reader = spark.read.option("basePath", f"{output}/data")
    outcome = reader.schema(T.StructType.fromJson(json.loads(log[-1]["columns"]))).parquet(*[f"{output}/{r['folder']}" for r in log])
    return results(outcome, refs.meta), errors(outcome)


def drop_uncommitted(spark: SparkSession, output: str) -> list[str]:
    """Remove what broken-off attempts left; only for a stream that doesn't run.  Gives the folders removed."""
    known = {r["folder"] for r in committed(spark, output).select("folder").collect()}
    found = [f"data/{e}/{a}" for e in folders_in(spark, f"{output}/data") for a in folders_in(spark, f"{output}/data/{e}")]
    lost = [folder for folder in found if folder not in known]
    for folder in lost:
        drop_folder(spark, f"{output}/{folder}")
    return lost
