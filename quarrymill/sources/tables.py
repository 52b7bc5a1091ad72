"""Parquet tables of a data folder, and the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

import quarrymill


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, beside what PYTHONPATH or --py-files give them."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(quarrymill.__file__)))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if home not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [home, *paths] if p)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the folder `sf_dir`, through Spark's reader alone, so any Hadoop path will do."""
    return importable(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names in `spark.checkpoint.dir`.

    Only where that setting is absent from a local session, as in tests, is a folder of our own set; it goes with the
    process. A session whose executors are elsewhere needs the setting: they couldn't read each other's files.
    """
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="quarrymill-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame, parts: int | None = None) -> DataFrame:
    """`df`, computed once and written to the checkpoint folder; its lineage ends there.

    parts: in so many files. Small tables of many partitions would be as many files, each costlier than its rows. The
    result is dealt anew for that, so what computes it keeps its own partitions.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df.repartition(parts) if parts else df).checkpoint(eager=True)


def gathered(df: DataFrame, parts: int) -> DataFrame:
    """`df` as by `cut`, in `parts` files at most. Its rows aren't dealt anew: its last step runs in so many tasks.

    For narrow rows that come from a group-by or join. Dealing them anew would take one task more for each partition of
    the session's number, and what the driver holds and throws away grows with its tasks.
    """
    return cut(df.coalesce(parts))


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join of which no side may be sent to the driver and to all tasks.

    Spark takes a table that functions have made for as large as the columns it was made of: files of a few hundred bytes
    that are written for each key of a table, or what is read in them, pass for a few bytes a row, and are broadcast.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str, each: int = 20_000) -> DataFrame:
    """`df` dealt by its keys into parts of about `each` rows.

    For narrow rows of which each becomes much text or much work: by bytes, Spark reads a table of millions of them in a few
    tasks. The parts are written to the checkpoint folder: else conditions on what the rows become would be pushed below
    the dealing, work and all, into those few tasks, and each use would deal the rows again.
    """
    return cut(df.repartition(parts_for(df.count(), each), *keys))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """`df` dealt by the keys of the next join or group-by into `parts`; left to the session's number if None.

    That number, and parts put together by their compressed bytes, make a task grow with the table.
    """
    return df.repartition(parts, *keys) if parts else df


def parts_for(rows: int, each: int = 100_000) -> int:
    """How many partitions a table of narrow rows is worth."""
    return max(8, -(-rows // each))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
