"""Session helpers shared by the operators: table access, the shared work folder, staged tables."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: White space that separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a folder, read by Spark alone (any file system that Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, and keep Arrow batches small, so that batches of long texts fit a Python worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only in local mode, where that may be unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="inkspark-")
        _WRITTEN.append((spark, root))
    if not context.getCheckpointDir():
        context.setCheckpointDir(root)
    return root


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, on storage that outlives executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._inkspark_folder = path
    return out


def release(df: DataFrame) -> None:
    """Delete the folder of a staged table that no plan will read again."""
    path = df._inkspark_folder
    _delete(df.sparkSession, path)
    _WRITTEN[:] = [w for w in _WRITTEN if w[1] != path]


#: Keys with more than this share of the rows are hot: there are fewer of them than its inverse.
HOT_SHARE = 1 / 2048


def join_spread(rows: DataFrame, small: DataFrame, keys: list[str], count: str, total: int, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """``rows`` joined with ``small`` (one row per key, ``count`` of them in ``rows``), so that no hot key meets in one task.

    Hot keys (at most ``1 / share`` by their definition) are broadcast; the others go by an ordinary join.  Both tables are
    read twice and should be staged."""
    hot = F.col(count) > max(1.0, total * share)
    spread, rest = F.broadcast(small.filter(hot).drop(count)), small.filter(~hot).drop(count)
    cold = rows.join(F.broadcast(small.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(spread, keys, how).unionByName(cold.join(rest, keys, how))


def cut(df: DataFrame) -> DataFrame:
    """Write a small table of an iteration into the shared folder; unlike ``checkpoint()`` this computes it once."""
    return staged(df, "cut")


def tidy(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001, S112  the session is gone: its folder is left to whoever owns it
            continue
