"""Where intermediate tables are held, and sums of arrays over many tasks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks that add up what other tasks have added up.
ADDERS = 4


_held: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; where it is unset, as in tests on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="litweave-held-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends."""
    path = f"{shared_folder(spark)}/litweave-held-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _held[path] = (at, at.getFileSystem(spark._jsc.hadoopConfiguration()))
    return path


def hold(df: DataFrame) -> DataFrame:
    """``df``, computed once and without its lineage: a table in the shared folder, until it is let go or the process ends."""
    spark = df.sparkSession
    path = own_folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.held_at = path
    return out


#: Rows of a held table for each partition of what is shuffled in its rounds, and rows from which rounds are run as any query.
ROUND_ROWS, MANY_ROWS = 20_000, 200_000


def in_rounds(held: DataFrame, rows: int) -> DataFrame:
    """``held``, of that many rows, in a session of its own for many small steps, where its number of rows and not the session's input decides how many partitions are shuffled.

    Plans are not made again between stages there, so that a step is one job. The settings of the table's session stay; a table of MANY_ROWS is left in it.
    """
    if rows >= MANY_ROWS:
        return held
    spark = held.sparkSession
    own = spark.newSession()
    for k in ("spark.checkpoint.dir", "spark.sql.session.timeZone"):
        if (v := spark.conf.get(k, None)) is not None and own.conf.get(k, None) != v:
            own.conf.set(k, v)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", 1 + rows // ROUND_ROWS)
    return read_in(own, held)


def read_in(spark: SparkSession, held: DataFrame) -> DataFrame:
    """``held`` as a table of another session; it is let go as before."""
    out = spark.read.schema(held.schema).parquet(held.held_at)
    out.held_at = held.held_at
    return out


def let_go(*held: DataFrame) -> None:
    """Deletes what ``hold`` wrote for these; nothing may read them any more."""
    for df in held:
        at, system = _held.pop(df.held_at)
        system.delete(at, True)


@atexit.register
def _let_all_go() -> None:
    for path in list(_held):
        with contextlib.suppress(Exception):  # the JVM may be gone, and the folder with it
            at, system = _held.pop(path)
            system.delete(at, True)


def summed(df: DataFrame, run: Callable[[pd.DataFrame], np.ndarray], width: int) -> np.ndarray:
    """The sum over all rows of what ``run`` makes of a batch of them; only ADDERS sums reach the driver."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(width), 0
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                total += run(pdf.iloc[at : at + 512])
            rows += len(pdf)
        if rows:
            yield pd.DataFrame({"to": [rows % ADDERS], "x": [total.tobytes()]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_rows = np.zeros(width), False
        for pdf in batches:
            for raw in pdf["x"]:
                total, any_rows = total + np.frombuffer(raw), True
        if any_rows:
            yield pd.DataFrame({"x": [total.tobytes()]})

    sums = df.mapInPandas(first, "to int, x binary").repartition(ADDERS, "to").mapInPandas(again, "x binary")
    out = np.zeros(width)
    for r in sums.collect():
        out += np.frombuffer(r["x"])
    return out


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``number``: the place of each row, from 1, by the columns of ``order``, which must tell rows apart.

    Rows are dealt by ranges and counted in their range; only the ranges' sizes are added up in one task.
    """
    dealt = hold(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("number", F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
