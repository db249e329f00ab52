"""Small helpers of the corpus operators: shared folders, written tables, text columns, hashing of byte windows."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(column, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where the cluster names one. Without it a purely local session gets a temporary folder of its
    own, and any other session a folder in the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        found = "file://" + tempfile.mkdtemp(prefix="corpus-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_corpus"
    spark.sparkContext.setCheckpointDir(found)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by all later steps, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove tables of :func:`written` that nothing reads any more."""
    for frame in frames:
        where = spark._jvm.org.apache.hadoop.fs.Path(frame._written_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, and not when the driver happens to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


_A, _B, _C = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 1 << 14  # places whose digests are made at a time, so that the arrays stay in a core's cache


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at every place, as numbers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _blocks(positions: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Cuts of rising positions into blocks that reach over at most ``reach`` places."""
    cut = np.searchsorted(positions, np.arange(positions[0], positions[-1] + reach + 1, reach))
    return [(int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a]


def few_window_digests(data: np.ndarray, positions: np.ndarray, width: int) -> np.ndarray:
    """64-bit digests of the windows of ``width`` bytes (8 or more) at some places of a text.

    Equal bytes have equal digests in every text; different bytes have different ones but for a chance of 2**-64 a pair.
    Words of 8 bytes are read at the places asked for only, which pays where they are few.
    """
    words, out = _words(np.ascontiguousarray(data)), np.empty(len(positions), np.uint64)
    for at in range(0, len(positions), _BLOCK):
        own = positions[at:at + _BLOCK]
        h = np.full(len(own), width, np.uint64)
        for offset in (*range(0, width - 8, 8), width - 8):
            h *= _A
            h ^= words[own + offset]
            mixed(h)
        out[at:at + _BLOCK] = h
    return out


def window_digests(data: np.ndarray, positions: np.ndarray, width: int) -> np.ndarray:
    """As :func:`few_window_digests`, but with other digests, for rising places that lie close together.

    Digests of all windows of 8, 32, 128, ... bytes around the places are made from four of the size before; a window of another
    width is as many overlapping ones as cover it.
    """
    data, out = np.ascontiguousarray(data), np.empty(len(positions), np.uint64)
    for a, b in _blocks(positions, _BLOCK) if len(positions) else []:
        first = positions[a]
        level, size = _words(data[first:positions[b - 1] + width]).astype(np.uint64), 8
        mixed(level)
        while 4 * size <= width:
            n = len(level) - 3 * size
            new = level[:n] * _A
            new += level[size:n + size]
            new *= _B
            new += level[2 * size:n + 2 * size]
            new *= _C
            new += level[3 * size:]
            level, size = mixed(new), 4 * size
        own = positions[a:b] - first
        h = np.full(b - a, width, np.uint64)
        for offset in (*range(0, width - size, size), width - size):
            h *= _A
            h += level[own + offset]
            mixed(h)
        out[a:b] = h
    return out
