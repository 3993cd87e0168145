"""Helpers shared by the training-data operators: table reading, stage cuts, Arrow maps."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word and white-space classes of the contracts, for Java regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="boresight-"))
    return sc.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors cost no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(df: DataFrame) -> int:
    """UTF-8 bytes of all texts, to size partitions by."""
    return df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def parts_for(amount: float, each: float, least: int = 1) -> int:
    """Number of partitions so that none is meant to hold more than ``each``."""
    return max(least, math.ceil(amount / each))


def few(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` of so many ``rows`` in no more partitions than they need; else the files of the many tasks of a small frame outweigh it."""
    return df.coalesce(parts_for(rows, each))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most ``rows`` rows, so that long texts keep a worker's memory flat."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def same_id(left: Column, right: Column) -> Column:
    """Equality that also pairs null with null."""
    return left.eqNullSafe(right)


def keep_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose doc_id is (or, ``left_anti``, isn't) in ``ids.doc_id``; null equals null."""
    ids = ids.select(F.col("doc_id").alias("__wanted_id"))
    return docs.join(ids.hint("merge"), docs["doc_id"].eqNullSafe(ids["__wanted_id"]), how)  # alike at every size
