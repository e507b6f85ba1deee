"""Extension: drawings that arrive in a folder, as a stream. The batch operators take its rows as they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.sources.dxf import SCHEMA, parse


def drawing_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Entities of new drawings, as ``read_drawings`` gives them."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMA.replace("struct<x:double,y:double,z:double>", "s").split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([r for p, data in zip(b["path"], b["content"], strict=True) for r in parse(p, bytes(data))], columns=names)

    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.dxf").load(folder)
    return raw.select("path", "content").mapInPandas(run, SCHEMA)


def run_pipeline(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], target: str, checkpoint: str):
    """Each batch of drawings through a batch pipeline, appended to a Parquet table."""

    def one(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
