"""Masking of text streams."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspark.operators.keeping import shared_folder
from veilspark.plans.scan import ScanResult, scan
from veilspark.sources.rules import Catalogue


def text_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, one document each: ``(path, text)``."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files_per_trigger)
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def mask_stream(
    stream: DataFrame,
    text: str,
    ids: list[str],
    categories: Iterable[str] | None = None,
    catalogue: Catalogue | None = None,
) -> ScanResult:
    """The scan of a streaming DataFrame.

    Detection, resolution, naming and masking all happen inside a row, so the
    same plan runs on a stream in append mode, without state or watermark.
    """
    return scan(stream, text, ids, categories, catalogue=catalogue)


def write_masked(
    stream: DataFrame,
    text: str,
    ids: list[str],
    masked_path: str,
    checkpoint: str,
    vault_path: str | None = None,
    categories: Iterable[str] | None = None,
    once: bool = True,
    catalogue: Catalogue | None = None,
    findings_path: str | None = None,
) -> StreamingQuery:
    """Mask a stream into parquet; findings and the map go to their folders in the same micro-batch.

    A batch is scanned once for all its outputs. Its id names the folders, so a batch that is repeated after a failure writes over what
    it left behind: its outputs and its sealed rows in the shared folder. When all outputs of a batch are
    there it gets a mark beside the masked texts; ``read_committed`` shows marked batches only, so no reader sees
    masked texts without their map.
    """
    spark = stream.sparkSession
    rows = f"{shared_folder(spark).rstrip('/')}/veilspark-stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:32]}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        result = scan(batch, text, ids, categories, catalogue=catalogue)
        if findings_path is None and vault_path is None:
            result.masked.write.mode("overwrite").parquet(f"{masked_path}/batch={batch_id}")
            _marked(spark, masked_path, batch_id)
            return
        kept = result.kept(f"{rows}-{batch_id}")
        try:
            if vault_path is not None:
                kept.map.write.mode("overwrite").parquet(f"{vault_path}/batch={batch_id}")
            if findings_path is not None:
                kept.findings.write.mode("overwrite").parquet(f"{findings_path}/batch={batch_id}")
            kept.masked.write.mode("overwrite").parquet(f"{masked_path}/batch={batch_id}")
            _marked(spark, masked_path, batch_id)
        finally:
            kept.discard()

    return _start(stream, sink, checkpoint, once)


def _marks(spark: SparkSession, masked_path: str):
    """The folder of the marks and its file system; readers of tables pass by names with an underscore."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{masked_path}/_committed")
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def _marked(spark: SparkSession, masked_path: str, batch_id: int) -> None:
    folder, files = _marks(spark, masked_path)
    files.create(spark._jvm.org.apache.hadoop.fs.Path(folder, str(batch_id)), True).close()


def committed_batches(spark: SparkSession, masked_path: str) -> list[int]:
    """Ids of the batches of which all outputs are written: one small file each."""
    folder, files = _marks(spark, masked_path)
    return sorted(int(f.getPath().getName()) for f in files.listStatus(folder)) if files.exists(folder) else []


def read_committed(spark: SparkSession, path: str, masked_path: str, schema: str) -> DataFrame:
    """The rows of finished batches of an output of ``write_masked``, with the id of their ``batch``."""
    table = spark.read.schema(f"{schema}, batch BIGINT").option("basePath", path)
    folders = [f"{path}/batch={n}" for n in committed_batches(spark, masked_path)]
    return table.parquet(*folders) if folders else spark.createDataFrame([], f"{schema}, batch BIGINT")


def _start(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool
) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
