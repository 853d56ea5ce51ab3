"""Reading the shared Parquet tables and keeping intermediate ones."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []
#: What else forgets the tables when they are deleted.
forgetting: list[Callable[[], None]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one in `spark.checkpoint.dir`, else the context's checkpoint folder. Only a
    single-process local session, as in tests, gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="mnemora-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str, dense: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again; with `dense` in fewer bytes and more time.

    This cuts the lineage: later readers need neither the executors nor the work that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.option("compression", "zstd") if dense else df.write).parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made and nothing reads any more; and let Spark delete the shuffles of what has ended.

    Spark deletes them when the driver's garbage is collected, which may be long after the disk is full.
    """
    for df in tables:
        if path := df.__dict__.get("_written_at"):
            _deleted(df.sparkSession, path)
            _written[:] = [x for x in _written if x[1] != path]
    gc.collect()
    tables[0].sparkSession.sparkContext._jvm.System.gc()


#: Most ids with digests that are broadcast: some 100 bytes each. Beyond it a join is an ordinary one.
BROADCAST_IDS = 500_000


def bounded(df: DataFrame, most: int = 200_000) -> DataFrame:
    """`df` with a hint to broadcast it if it has at most `most` rows; else without one."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(df: DataFrame, most: int = 20_000) -> DataFrame:
    """`df` as a local table of the plan, with a hint to broadcast it, if it has at most `most` rows; else written.

    For what a caller's few queries make: later plans needn't make it again, nor read a file, and what is
    selected from it alone is worked out while planning, without a job.
    """
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows > most:
        return written(df, "held")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def text_digest(text: Column) -> Column:
    """The SHA-256 of a text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def without(df: DataFrame, ids: DataFrame, key: str, digest: Column) -> DataFrame:
    """`df` without the rows whose `key` and `digest` are a row of `ids` (null equals null).

    Neither null nor repeated ids drop rows of other texts. The rows of `ids` are counted first: up to
    BROADCAST_IDS are broadcast, so that `df` needn't be shuffled.
    """
    ids = written(ids.toDF("_id", "_digest").distinct(), "ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return df.join(ids, df[key].eqNullSafe(ids["_id"]) & digest.eqNullSafe(ids["_digest"]), "left_anti")


def release() -> None:
    """Delete every table that `written` made in this process."""
    for forget in forgetting:
        forget()
    while _written:
        spark, path = _written.pop()
        try:
            _deleted(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


atexit.register(release)
