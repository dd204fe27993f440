"""Ledgers on storage whose rows are replaced scope by scope (a section, a draft), each replacement whole or not at all.

A replacement writes its rows and the scopes that they replace as Parquet under a name of its own, takes the next free number, and
is there for readers once that number is marked as committed. Readers take for each scope the rows of its latest committed
replacement. A write that dies before its mark leaves the old state; writers of different scopes do not wait for each other.

    path/rows/generation=g-…     rows, with their scope as a column
    path/scopes/generation=g-…   the scopes replaced, also those that have no rows any more
    path/claims/N                the number N is taken, by the generation in the file
    path/commits/N.g-…           replacement N is committed
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """A scope was replaced by another writer after the version that a write started from."""


class _Files:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, "/".join(parts))

    def names(self, folder: str) -> list[str]:
        at = self.at(folder)
        return [x.getPath().getName() for x in self.system.listStatus(at)] if self.system.exists(at) else []

    def create(self, text: str, *parts: str) -> bool:
        """Whether a new file was made; False if there is one of that name."""
        from py4j.protocol import Py4JJavaError

        try:
            out = self.system.create(self.at(*parts), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.system.exists(self.at(*parts)):
                return False
            raise
        out.writeBytes(text)
        out.close()
        return True

    def text(self, *parts: str) -> str:
        f = self.system.open(self.at(*parts))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")
        finally:
            f.close()

    def commits(self, version: int | None = None) -> list[tuple[int, str]]:
        """(number, generation) of the committed replacements, up to a version."""
        found = sorted((int(n), g) for n, _, g in (x.partition(".") for x in self.names("commits")))
        return [x for x in found if version is None or x[0] <= version]


def _scopes(spark: SparkSession, path: str, numbered: list[tuple[int, str]]) -> DataFrame:
    """(scope column, generation, number) of the given replacements."""
    numbers = spark.createDataFrame(numbered, "number long, generation string")
    parts = [f"{path}/scopes/generation={g}" for _, g in numbered]
    return spark.read.option("basePath", f"{path}/scopes").parquet(*parts).join(F.broadcast(numbers), "generation")


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the latest replacement, 0 if there is none."""
    return max((n for n, _ in _Files(spark, path).commits()), default=0)


def read_ledger(spark: SparkSession, path: str, scope: str, version: int | None = None) -> DataFrame:
    """The rows of all scopes as of a version, the latest if none is named; columns that only some replacements have are null in the others."""
    done = _Files(spark, path).commits(version)
    if not done:
        raise FileNotFoundError(f"no ledger at {path}" + (f" as of {version}" if version is not None else ""))
    now = _scopes(spark, path, done).groupBy(F.col(scope).alias("_scope")).agg(F.max_by("generation", "number").alias("_generation"))
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", "true").parquet(*[f"{path}/rows/generation={g}" for _, g in done])
    same = F.col(scope).eqNullSafe(F.col("_scope")) & (F.col("generation") == F.col("_generation"))
    return rows.join(now, same, "left_semi").drop("generation")


def replace_scopes(path: str, new: DataFrame, scope: str, scopes: DataFrame | None = None, since: int | None = None) -> int:
    """Replaces all rows of ``scopes`` (a column ``scope``; those of ``new`` if none are given) by ``new``; returns the version.

    A scope without rows in ``new`` becomes empty. Rows of ``new`` outside of the scopes are an error. Of two writers of one
    scope the later number stands as a whole; with ``since``, the version that the new rows were made from, a
    writer that comes second raises Conflict and changes nothing.
    """
    spark, files, generation = new.sparkSession, _Files(new.sparkSession, path), f"g-{uuid.uuid4().hex}"
    own = (new if scopes is None else scopes).select(scope).distinct()
    rows, held = f"{path}/rows/generation={generation}", f"{path}/scopes/generation={generation}"
    own.write.parquet(held)
    new.write.parquet(rows)
    own, written = spark.read.parquet(held), spark.read.schema(new.schema).parquet(rows)
    if scopes is not None:
        known = own.select(F.col(scope).alias("_scope"))
        if not written.join(known, F.col(scope).eqNullSafe(F.col("_scope")), "left_anti").isEmpty():
            raise ValueError(f"rows outside of the {scope}s that are replaced")
    number = max([int(n) for n in files.names("claims")], default=0) + 1
    while not files.create(generation, "claims", str(number)):
        number += 1
    if since is not None:
        others = [(n, files.text("claims", str(n))) for n in sorted(int(x) for x in files.names("claims")) if since < n < number]
        mine = own.select(F.col(scope).alias("_scope"))
        # a claim whose name is not written yet may be of the same scope
        if others and (not all(g for _, g in others) or not _scopes(spark, path, others).join(mine, F.col(scope).eqNullSafe(F.col("_scope")), "left_semi").isEmpty()):
            files.system.delete(files.at("claims", str(number)), False)
            raise Conflict(f"{scope}s were replaced after version {since}")
    files.create("", "commits", f"{number}.{generation}")
    return number
