"""Tables in the shared folder of the cluster, joins on hot keys, texts as byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task function works on at a time; a longer text is taken alone.
GROUP_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a folder of its own is set for a session in one process, as in
    tests; a cluster without the setting is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith(("local[", "local")) or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='veilspark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


@dataclass
class Stored:
    """A table written once; its lineage ends there."""

    frame: DataFrame
    path: str

    def drop(self) -> None:
        """Remove the table; only for tables that no returned DataFrame reads."""
        spark = self.frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, label: str) -> Stored:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/veilspark-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def hot_keys(df: DataFrame, key: str, share: float = 0.002, rows: int | None = None) -> list:
    """Keys with more than ``share`` of the rows: at most ``1 / share`` of them, whatever the table."""
    least = max(64.0, (df.count() if rows is None else rows) * share)
    many = df.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > F.lit(least))
    return [r[0] for r in many.select(key).collect() if r[0] is not None]


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    salts: int = 64,
    hot: list | None = None,
    by: Sequence[str] | None = None,
) -> DataFrame:
    """Join a large ``left`` with a ``right`` that has one row a key.

    The rows of a hot key of ``left`` are dealt over ``salts`` parts, by the columns ``by``,
    and its row of ``right`` is repeated for each. The hot keys are a list of 500 at most by
    their definition. ``left`` is read for it, so store it first, or give ``hot``.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    part = F.pmod(F.xxhash64(*(by or left.columns)), F.lit(salts)).cast("int")
    many = left.withColumn("_salt", F.when(is_hot, part).otherwise(0))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return many.join(right.withColumn("_salt", F.explode(parts)), [key, "_salt"], how).drop("_salt")


def hash_sample(df: DataFrame, rows: int, wanted: int, keys: Sequence[str]) -> DataFrame:
    """The ``wanted`` rows with the smallest hashes of ``keys``, of ``rows`` in all.

    Only rows that can be among them are sorted, so no task gets a share of every partition.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    reach = min(1.0, (1.2 * wanted + 64) / max(rows, 1))
    return df.where(place < F.lit(int(reach * (1 << 30)) + 1)).orderBy(place, *keys).limit(wanted)


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case, all other characters as they are; null is empty."""
    capitals = "".join(map(chr, range(65, 91)))
    return F.translate(F.coalesce(text, F.lit("")), capitals, capitals.lower())


# ---- texts as bytes, inside tasks ----


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the borders of its texts; null is empty."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.fill_null("")
    _, borders, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(borders, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def row_groups(borders: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive rows of at most ``limit`` bytes together, or one longer row."""
    first, n = 0, len(borders) - 1
    while first < n:
        last = int(np.searchsorted(borders, borders[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def flat_lists(values: Sequence[np.ndarray] | np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values, one after another, and the length of each list."""
    flat = np.concatenate(values) if isinstance(values, list) and values else np.asarray(values)
    borders = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders, pa.int32()), pa.array(flat, kind))
