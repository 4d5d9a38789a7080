"""Rows of a scan, written once for all results that read them; real values are sealed in what is written."""

from __future__ import annotations

import secrets
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.functions.text import chunked, cut


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a private one only in local mode where none is set."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="veilspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def new_folder(spark: SparkSession) -> str:
    """A name in the shared folder that no other job has."""
    return f"{shared_folder(spark).rstrip('/')}/veilspark-{uuid.uuid4().hex}"


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder that ``new_folder`` has named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Put a folder in the place of another one, if there is one."""
    paths = spark._jvm.org.apache.hadoop.fs.Path(old), spark._jvm.org.apache.hadoop.fs.Path(new)
    files = paths[1].getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(paths[1], True)
    files.mkdirs(paths[1].getParent())
    if not files.rename(*paths):
        raise OSError(f"{old} could not be renamed to {new}")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def sealing() -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Seal and open values with a random key that lives as long as the returned expressions.

    Equal values are sealed alike (the initial vector is a keyed hash of the value), so sealed values can be grouped
    and joined. Files that outlive a job then hold no real value. The key is a literal of the plan and nowhere else.
    """
    key = F.lit(bytearray(secrets.token_bytes(32)))
    salt = F.lit(secrets.token_hex(32))
    mode, padding = F.lit("CBC"), F.lit("PKCS")

    def seal(value: Column) -> Column:
        vector = F.unhex(F.substring(F.sha2(F.concat(salt, value), 256), 1, 32))
        return F.aes_encrypt(value.cast("binary"), key, mode, padding, vector)

    def unseal(value: Column) -> Column:
        return F.aes_decrypt(value, key, mode, padding).cast("string")

    return seal, unseal


def gaps(text: Column, spans: Column) -> Column:
    """The plain parts of a text, one more than it has spans; the whole text where it has none."""

    def between(chunks: Column) -> Column:
        before = F.transform(
            spans,
            lambda s, i: cut(chunks, F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(F.lit(0)), s["start"]),
        )
        return F.concat(before, F.array(cut(chunks, F.get(spans, F.size(spans) - 1)["end"], F.length(text))))

    return F.when(found(spans), let(chunked(text), between)).otherwise(F.array(text))


def found(spans: Column) -> Column:
    return F.coalesce(F.size(spans), F.lit(0)) > 0


def filled(plain: Column, spans: Column, shown: Callable[[Column], Column]) -> Column:
    """The text again, ``shown`` of each span between its plain parts; a null text stays null."""
    pieces = F.transform(plain, lambda g, i: F.concat(g, F.coalesce(shown(F.get(spans, i)), F.lit(""))))
    return F.when(found(spans), F.array_join(pieces, "")).otherwise(F.get(plain, F.lit(0)))


def changed_values(df: DataFrame, change: Callable[[Column], Column]) -> Column:
    """The spans of a table with ``change`` applied to their values."""
    fields = df.schema["_spans"].dataType.elementType.names
    return F.transform(
        "_spans",
        lambda s: F.struct(*[(change(s[f]) if f == "value" else s[f]).alias(f) for f in fields]),
    )


def stored(
    rows: DataFrame, ids: Sequence[str], text: str, seal: Callable[[Column], Column], folder: str | None = None
) -> tuple[DataFrame, str]:
    """``(_row, ids, _gaps, _spans)`` written as Parquet into the shared folder, and where.

    The texts are scanned here, once. ``_row`` names a row, also where ids are null or repeated. What lies in a
    given ``folder`` is written over.
    """
    folder = folder or new_folder(rows.sparkSession)
    rows.select(
        F.monotonically_increasing_id().alias("_row"),
        *ids,
        gaps(F.col(text), F.col("_spans")).alias("_gaps"),
        changed_values(rows, seal).alias("_spans"),
    ).write.mode("overwrite").parquet(folder)
    return rows.sparkSession.read.parquet(folder), folder
