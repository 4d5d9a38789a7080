"""Readers and writers for texts, lines, findings and maps."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.arrays import let, running_sum
from veilspark.operators.keeping import removed, renamed
from veilspark.plans.scan import ScanResult


#: Setting of a session that wants its inputs dealt over that many partitions; unset, texts are never shuffled.
READ_PARTITIONS = "spark.veilspark.readPartitions"


def dealt(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The input in as many partitions as the session asks for: for files of one row group on one machine."""
    wanted = df.sparkSession.conf.get(READ_PARTITIONS, None)
    return df.repartition(int(wanted), *ids) if wanted else df


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one document, also an empty one: ``(path, text)``."""
    files = spark.read.text(path, wholetext=True)
    written = lambda name: F.regexp_replace(name, "^file:/+", "file:///")  # noqa: E731  local paths have two spellings
    texts = files.select(written(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    # An empty file gives no row, but it is in the listing that Spark has made for the scan.
    listed = spark.createDataFrame([(name,) for name in files.inputFiles()], "path STRING").select(written(F.col("path")).alias("path"))
    empty = listed.join(texts.select("path"), "path", "left_anti").withColumn("text", F.lit(""))
    return dealt(texts.unionByName(empty), ["path"])


def read_documents(
    spark: SparkSession, path: str, ids: Sequence[str] = ("doc_id",), text: str = "text"
) -> DataFrame:
    """A table of documents; only the id and text columns are read."""
    return dealt(spark.read.parquet(path).select(*ids, text), ids)


def lines(df: DataFrame, text: str, ids: Sequence[str]) -> DataFrame:
    """``(ids, line_no, line_start, line)``: split at line feeds only, empty lines kept.

    The offsets are running lengths inside the row, so no shuffle is needed.
    """
    pieces = F.split(F.col(text), "\n", -1)

    def placed(p):
        ends = running_sum(F.transform(p, lambda line: F.length(line) + 1))
        return let(
            ends,
            lambda e: F.transform(
                p,
                lambda line, i: F.struct(
                    i.alias("line_no"),
                    (F.get(e, i) - F.length(line) - 1).alias("line_start"),
                    line.alias("line"),
                ),
            ),
        )

    return df.select(*ids, F.explode(let(pieces, placed)).alias("_l")).select(*ids, "_l.*")


def write_scan(
    result: ScanResult,
    masked_path: str,
    findings_path: str,
    vault_path: str | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """Write masked texts and findings; the map only where an explicit vault path is given.

    A vault is never written over: older masked texts need it to be restored. ``partition_by`` are id columns of the
    scan, such as those that the input is partitioned by; masked texts and findings get folders for their values.

    The texts are scanned once, into the shared folder with sealed values, and
    all outputs are read from there. Masked texts and findings are written beside their places and put there
    one after the other when both are complete, so a job that fails leaves the older ones.
    """
    if not set(partition_by) <= set(result.ids):
        raise ValueError("partition columns must be id columns of the scan")
    if vault_path is not None:
        for other in (masked_path, findings_path):
            one, two = vault_path.rstrip("/") + "/", other.rstrip("/") + "/"
            if one.startswith(two) or two.startswith(one):
                raise ValueError("the vault must not share a folder with masked texts or findings")
    spark = result.rows.sparkSession
    kept = result.kept()
    places = [p.rstrip("/") for p in (masked_path, findings_path)]
    fresh = [f"{p}.new-{uuid.uuid4().hex}" for p in places]
    try:
        if vault_path is not None:
            kept.map.write.mode("errorifexists").format(fmt).save(vault_path)
        for table, folder in zip((kept.masked, kept.findings), fresh, strict=True):
            table.write.format(fmt).partitionBy(*partition_by).save(folder)
        for folder, place in zip(fresh, places, strict=True):
            renamed(spark, folder, place)
    finally:
        for folder in fresh:
            removed(spark, folder)
        if kept is not result:
            kept.discard()


def write_masked_text(result: ScanResult, path: str) -> None:
    """Masked texts as lines of JSON with their ids; line feeds of a text stay inside its line."""
    result.masked.write.mode("overwrite").json(path)
