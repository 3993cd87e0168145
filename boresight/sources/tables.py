"""Sources and sinks: tables, well masters, pages, append-only logs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, for what several branches of a plan read.

    The folder is the one of ``spark.checkpoint.dir``; a local session without it gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="boresight-"))
    return df.checkpoint()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{d}/{name}.parquet")


def wells(spark: SparkSession, path: str) -> DataFrame:
    """A JSON well master, one row a well with its ordinal."""
    master = spark.read.option("multiLine", True).json(path)
    return master.select("active_well_id", F.posexplode("wells").alias("well_ord", "w")).select("active_well_id", "well_ord", "w.*")


def unnest(rows: DataFrame, entity: str, column: str) -> DataFrame:
    """A row for each element of an array of structs."""
    return rows.select(F.col(entity), F.explode(column).alias("__x")).select(entity, "__x.*")


def live_events(spark: SparkSession, path: str) -> DataFrame:
    """The event base without rejected entries; the filter reaches the scan."""
    return spark.read.parquet(path).where("status <> 'rejected'")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Binary documents with the digest that keys their page cache."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("doc_id"), F.sha2("content", 256).alias("sha256"), "content")


def pages(documents: DataFrame, reader, schema: str = "doc_id string, page_no int, text string, method string, ocr_conf double") -> DataFrame:
    """Pages of binary documents by a caller's parser: ``reader(bytes) -> [(text, method, conf)]``."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, i + 1, *page) for d, content in zip(pdf["doc_id"], pdf["content"]) for i, page in enumerate(reader(content))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_no", "text", "method", "ocr_conf"])

    return documents.select("doc_id", "content").mapInPandas(run, schema)


def assemble_rows(boxes: DataFrame, page: list[str], gap: float = 12.0) -> DataFrame:
    """Lines of a scanned page: boxes(x, y, text, conf) sorted by (y, x), a line ends ``gap`` below its first box."""
    item = F.struct("y", "x", "text", "conf")
    lists = boxes.groupBy(*page).agg(F.array_sort(F.collect_list(item)).alias("b"), F.avg("conf").alias("ocr_conf"))
    start = F.struct(F.array().cast("array<array<struct<x:double,text:string>>>").alias("lines"), F.lit(None).cast("double").alias("y0"))

    def step(s, b):
        word = F.struct(b["x"].cast("double").alias("x"), b["text"].alias("text"))
        new = s["y0"].isNull() | (F.abs(b["y"] - s["y0"]) >= gap)
        last = F.size(s["lines"])
        joined = F.concat(F.slice(s["lines"], 1, F.greatest(last - 1, F.lit(0))), F.array(F.concat(F.element_at(s["lines"], -1), F.array(word))))
        return F.struct(F.when(new, F.concat(s["lines"], F.array(F.array(word)))).otherwise(joined).alias("lines"), F.when(new, b["y"].cast("double")).otherwise(s["y0"]).alias("y0"))

    lines = F.aggregate("b", start, step, lambda s: F.transform(s["lines"], lambda line: F.concat_ws(" ", F.transform(F.array_sort(line), lambda w: w["text"]))))
    return lists.select(*page, F.concat_ws("\n", lines).alias("text"), "ocr_conf")


def append(log: DataFrame, path: str) -> None:
    """Append entries of a review, audit or feedback log."""
    log.write.mode("append").parquet(path)


def rebuild(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a table anew."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def series_schema() -> T.StructType:
    """Schema of the ten-second drilling records."""
    names = ("t", "bit_md", "hole_md", "rop", "wob", "rpm", "torque", "hookload", "spp", "flow_in", "flow_out", "pit", "mw", "ecd", "gas", "on_bottom")
    return T.StructType([T.StructField("session", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in names]])


def record_stream(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Drilling records as a file stream; the files a trigger takes set the replay speed."""
    return spark.readStream.schema(series_schema()).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
