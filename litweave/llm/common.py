"""What the corpus operators share: the shared scratch folder, cut lineage, parts of batches, connected components."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+`` as a Java character class body.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"
#: Characters of text that a Python worker takes up at once, if one text alone is not longer.
CHARS_AT_ONCE = 2_000_000
SALTS = 8
_written: dict[str, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session does not name one (tests on one machine) a temporary folder is set,
    and removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="litweave-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


class Cut:
    """A table in the shared folder: ``df`` reads it, ``drop`` deletes it once nothing reads it any more."""

    def __init__(self, df: DataFrame) -> None:
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/litweave-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        _written[self.path] = (at, at.getFileSystem(spark._jsc.hadoopConfiguration()))
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.path)


def _delete(path: str) -> None:
    at, system = _written.pop(path)
    system.delete(at, True)


@atexit.register
def _delete_all() -> None:
    """Tables that results may still read are deleted when the driver's process ends."""
    for path in list(_written):
        with contextlib.suppress(Exception):  # the JVM may be gone, and the folder with it
            _delete(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back, so that a lost executor costs no recomputation.

    The table stays until the driver's process ends, as a result that reads it may be computed at any time.
    """
    return Cut(df).df


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut`` into buckets by ``key``, one for each shuffle partition, so that grouping and joining by it does not shuffle the table again."""
    spark = df.sparkSession
    own = uuid.uuid4().hex
    path = f"{shared_dir(spark)}/litweave-{own}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written[path] = (at, at.getFileSystem(spark._jsc.hadoopConfiguration()))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(f"litweave_{own}")
    return spark.table(f"litweave_{own}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def unused(columns: list[str], name: str) -> str:
    """``name``, with signs after it as long as a column has that name (names are compared without case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name += "_"
    return name


def portions(batches: Iterator[pd.DataFrame], column: str = "text", most: int = CHARS_AT_ONCE) -> Iterator[pd.DataFrame]:
    """The rows of Arrow batches (which Spark bounds in bytes) in portions of at most ``most`` characters, or one row."""
    for pdf in batches:
        ends = np.fromiter((len(t) if isinstance(t, str) else 0 for t in pdf[column].array), np.int64, len(pdf)).cumsum()
        at = 0
        while at < len(pdf):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield pdf.iloc[at:to].reset_index(drop=True)
            at = to


def with_lowest(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with ``m``, the smallest v of each u."""
    e = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    parts = e.groupBy("u", "salt").agg(F.min("v").alias("m"))
    low = parts.groupBy("u").agg(F.min("m").alias("m"))
    return e.join(parts.select("u", "salt").join(low, "u"), ["u", "salt"]).select("u", "v", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """Alternating large-star and small-star over ``edges`` (a, b), as many rounds as it takes.

    Returns (node, component): the smallest node reachable, for every node that has an edge to
    another node. Null ends and loops link nothing. Each round is written to the shared folder and the one before
    it deleted; neighbourhoods are never collected, only their minimum is aggregated, so a node with many
    links is no larger a row than any other, and its edges are joined in SALTS parts.
    """
    e = Cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a is not null and b is not null and a <> b")
        .distinct()
    )
    before = None
    while True:
        both = e.df.unionByName(e.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = Cut(
            with_lowest(both)
            .withColumn("m", F.least("m", "u"))
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        small = Cut(
            with_lowest(large.df)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        large.drop()
        e.drop()
        e = small
        now = e.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
