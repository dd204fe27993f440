"""Export files by ranges of bytes: a Python data source, so that one large file is the work of many tasks.

    spark.dataSource.register(ExportSource)
    spark.read.format("litweave-exports").option("range_bytes", 1 << 25).load("hdfs://host/exports")

Tagged formats, BibTeX and JSON lines are parted at lines that open a record. A record belongs to the range in which its
opening line begins, wherever it ends; so the records are the same for any size of ranges, and a task holds one record at a
time. Files of other formats (tables, workbooks, JSON) have no such lines, and are one range each.
"""

from __future__ import annotations

import io
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import parsers as P

SCHEMA = "path string, place long, kind string, style string, fields map<string,array<string>>, error string"
#: Bytes of a range, and what opening a file counts for when small files share a task.
RANGE_BYTES, OPEN_BYTES = 1 << 25, 1 << 20
#: How a line that opens a record begins, for formats in which the tag stands in signs (fixed values).
BEGINS = {"enw": b"%0", "net": b"{Reference Type}"}
ENTRY = re.compile(rb"@\w+[ \t]*\{")


def opener(style: str) -> Callable[[bytes], bool]:
    """Whether a line opens a record of a style that can be parted."""
    if style == "jsonl":
        return lambda line: True
    if style == "bibtex":
        return lambda line: ENTRY.match(line) is not None
    pattern, opens, _ = P.TAGGED[style]
    line_of, begins = re.compile(pattern), BEGINS.get(style, opens.encode())

    def check(line: bytes) -> bool:
        if not line.startswith(begins):
            return False
        hit = line_of.fullmatch(line.decode("utf-8", "replace").splitlines()[0])
        return hit is not None and hit[1] == opens

    return check


def stretches(f: io.BufferedReader, start: int, end: int, opens: Callable[[bytes], bool]) -> Iterator[tuple[int, bytes]]:
    """(first byte, bytes) of the stretches from one opening line to the next that begin in ``start`` to ``end``; byte 0 opens one."""
    f.seek(max(start - 1, 0))
    at = start - 1 + len(f.readline()) if start else 0
    first, lines = None, []
    for line in f:
        if at == 0 or opens(line):
            if lines:
                yield first, b"".join(lines)
            if at >= end:
                return
            first, lines = at, [line]
        elif lines:
            lines.append(line)
        elif at >= end:  # no record begins in the range
            return
        at += len(line)
    if lines:
        yield first, b"".join(lines)


def style_of(path: str, f: io.BufferedReader) -> str | None:
    """A file's style by its suffix, or by its head where the suffix leaves it open."""
    style = P.SUFFIXES.get(path.rpartition(".")[2].lower())
    if style == "sniffed":
        f.seek(0)
        head = f.read(4 * P.WOS_HEAD).decode("utf-8-sig", "replace")[: P.WOS_HEAD]
        return "wos" if any(s.search(head) for s in P.WOS_SIGNS) else None
    return style


def rows_of(path: str, f: io.BufferedReader, start: int, end: int) -> Iterator[tuple]:
    """SCHEMA rows of a range; ``place`` is the byte at which a record's stretch begins, in whole files its number."""
    style = style_of(path, f)
    if style not in (*P.TAGGED, "bibtex", "jsonl"):
        if start:  # a file that cannot be parted belongs to its first range
            return
        f.seek(0)
        try:
            kind, style, found = P.parse(path, f.read())
            rows = [(path, i, kind, style, r, None) for i, r in enumerate(found)]
        except Exception as e:  # noqa: BLE001  one file's error is a row
            rows = [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
        yield from rows
        return
    for at, raw in stretches(f, start, end, opener(style)):
        text = raw.decode("utf-8" if at else "utf-8-sig", "replace")
        try:
            if style in P.TAGGED:
                found = [("tagged", r) for r in P.tagged(text, style)]
            elif style == "bibtex":
                found = [("table", r) for r in P.bibtex(text)]
            else:
                found = [("table", P.keyed(json.loads(text)))] if text.strip() else []
        except (ValueError, AttributeError) as e:  # a line that is no object; the other lines are read
            yield path, at, None, None, None, f"{type(e).__name__}: {e}"
            continue
        for i, (kind, r) in enumerate(found):
            yield path, at + i, kind, style, r, None


@dataclass
class Ranges(InputPartition):
    """Ranges (path, start, end) that one task reads."""

    ranges: list[tuple[str, int, int]]


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what comes before that path in its address)."""
    uri = re.sub(r"^s3[an]:", "s3:", path)
    uri = re.sub(r"^file:/*", "/", uri)
    if "://" not in uri:
        uri = os.path.abspath(uri)
    system, inner = fs.FileSystem.from_uri(uri)
    head = path[: -len(inner)] if "://" in path and path.endswith(inner) else "file:" if "://" not in uri else uri[: -len(inner)]
    return system, inner, head


class RangeReader(DataSourceReader):
    def __init__(self, paths: list[str], range_bytes: int) -> None:
        self.paths, self.range_bytes = paths, range_bytes

    def partitions(self) -> list[Ranges]:
        """Files under the paths by their suffixes, in ranges; small files share a task."""
        found = {}
        for path in self.paths:
            system, inner, head = file_system(path)
            info = system.get_file_info(inner)
            infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
            found |= {head + x.path: x.size for x in infos if x.is_file and x.extension.lower() in P.SUFFIXES}
        out, now, size = [], [], 0
        for path in sorted(found):
            whole = P.SUFFIXES[path.rpartition(".")[2].lower()] in ("table", "workbook", "json")
            step = max(found[path], 1) if whole else self.range_bytes
            for start in range(0, max(found[path], 1), step):
                end = min(start + step, found[path])
                if now and size + end - start + OPEN_BYTES > self.range_bytes:
                    out.append(Ranges(now))
                    now, size = [], 0
                now.append((path, start, end))
                size += end - start + OPEN_BYTES
        return [*out, Ranges(now)] if now else out

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, start, end in partition.ranges:
            system, inner, _ = file_system(path)
            try:
                f = io.BufferedReader(system.open_input_file(inner), 1 << 20)
            except OSError as e:
                if start == 0:
                    yield path, None, None, None, None, f"{type(e).__name__}: {e}"
                continue
            with f:
                yield from rows_of(path, f, start, end)


class ExportSource(DataSource):
    """Raw fields of the records of export files; options ``path`` or ``paths`` (a JSON list) and ``range_bytes``."""

    @classmethod
    def name(cls) -> str:
        return "litweave-exports"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        paths = json.loads(self.options["paths"]) if "paths" in self.options else [self.options["path"]]
        return RangeReader(paths, int(self.options.get("range_bytes", RANGE_BYTES)))


def matching(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths with their patterns filled in; a path that matches nothing is an error."""
    jvm, conf, out = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(conf).globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        out += [x.getPath().toString() for x in found]
    return out


def raw_ranges(spark: SparkSession, path: str | list[str], range_bytes: int = RANGE_BYTES):
    """SCHEMA rows of all export files under ``path``, which may be a list and hold patterns."""
    spark.dataSource.register(ExportSource)
    found = matching(spark, [path] if isinstance(path, str) else path)
    return spark.read.format(ExportSource.name()).option("paths", json.dumps(found)).option("range_bytes", str(range_bytes)).load()
