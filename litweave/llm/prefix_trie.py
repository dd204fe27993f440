"""The trie of conversation prefixes, with totals of subtrees by leaf peeling.

A node is a distinct sequence of first turns (role, text); it is told apart by 128 bits, the exclusive or of a hash of each
place with its turn. A conversation is a member of every node on its way from the root. Each node belongs to the path of
one of its members, the one whose id has the smallest hash. Paths run downwards without a gap, and as the hash orders members at
random, a way from the root changes paths about as often as the logarithm of its members.

Paths hold counters of the child paths they wait for. In each round the paths that wait for none send their totals to the
paths they hang from and leave, until only the root's path has finished; its nodes and those of all others then add up what they
got by running sums along their paths. No node's children, members or turns are gathered: counts, minima and sums are
aggregated before they are shuffled, long paths and conversations are numbered and summed in chunks, and nodes with very
many children, of which there are at most ``HOT_NODES``, reach their children by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Cut, cut

#: Places of a conversation or a path that one task sums in order.
CHUNK = 1_024
#: Most nodes whose children find them by broadcast; these have more than FEW_CHILDREN children and a share of all nodes of 1 / HOT_NODES.
HOT_NODES, FEW_CHILDREN = 1_000, 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, bytes): every turn's place from 1, two hashes of its role and text, and the UTF-8 bytes of its text.

    Turns stand in the order of ``turn``, null first; turns of one number by role and then by the SHA-256 of their text. Null roles and
    texts count as empty. Rows without conv_id belong to no conversation. A long conversation is numbered by many tasks.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")]
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    t = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    t = t.select(
        "conv_id", "turn", "role", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("bytes"),
        F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
    )
    dealt = cut(t.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    before = counts.select("conv_id", "range", (F.sum("n").over(W.partitionBy("conv_id").orderBy("range")) - F.col("n")).alias("before"))
    own = dealt.withColumn("own", F.row_number().over(W.partitionBy("conv_id", "range").orderBy(*order)))
    return own.join(before, ["conv_id", "range"]).select("conv_id", (F.col("before") + F.col("own")).alias("place"), "a", "b", "bytes")


def running(df: DataFrame, key: str, place: str, values: list[str], total: Callable, add: Callable[[Column, Column], Column], down: bool = False) -> DataFrame:
    """``df`` with each of ``values`` replaced by its total over the rows of the key up to its place (``down``: from the last one on).

    Totals are taken within chunks of CHUNK places and over chunks, so that a key of any size is the work of many tasks.
    """
    ordered = (lambda c: F.col(c).desc()) if down else F.col
    d = df.withColumn("_chunk", F.floor(F.col(place) / CHUNK))
    earlier = W.partitionBy(key).orderBy(ordered("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    chunks = d.groupBy(key, "_chunk").agg(*[total(v).alias(v) for v in values])
    chunks = chunks.select(key, "_chunk", F.row_number().over(W.partitionBy(key).orderBy(ordered("_chunk"))).alias("_nth"), *[total(v).over(earlier).alias(f"_{v}") for v in values])
    upto = W.partitionBy(key, "_chunk").orderBy(ordered(place)).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumns({v: total(v).over(upto) for v in values}).join(chunks.where("_nth > 1").drop("_nth"), [key, "_chunk"], "left")
    return d.withColumns({v: F.coalesce(add(F.col(v), F.col(f"_{v}")), F.col(v)) for v in values}).drop("_chunk", *[f"_{v}" for v in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, place, a, b, bytes) with the id (x, y) of the node each leads to, and that of the node before."""
    t = turns.select("conv_id", "place", "bytes", F.xxhash64("place", "a", "b").alias("own_x"), F.xxhash64("b", "a", "place").alias("own_y"))
    t = t.withColumns({"x": F.col("own_x"), "y": F.col("own_y")})
    t = running(t, "conv_id", "place", ["x", "y"], F.bit_xor, lambda p, q: p.bitwiseXOR(q))
    return t.select("conv_id", "place", "bytes", "x", "y", F.col("x").bitwiseXOR(F.col("own_x")).alias("px"), F.col("y").bitwiseXOR(F.col("own_y")).alias("py"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ids of each node, of rows sorted by node and id; a node's ids are never held at once."""
    node, sha = None, hashlib.sha256()
    for pdf in batches:
        out, start = [], 0
        keys = list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True))
        ids = pdf["conv_id"].tolist()
        for at in range(1, len(keys) + 1):
            if at < len(keys) and keys[at] == keys[start]:
                continue
            if keys[start] != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = keys[start], hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(",".join(map(str, ids[start:at])).encode())
            start = at
        yield pd.DataFrame(out, columns=["x", "y", "ends_sha256"])
    if node is not None:
        yield pd.DataFrame([(*node, sha.hexdigest())], columns=["x", "y", "ends_sha256"])


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with n_children, and parent_conv_id and parent_path of the node above (root: null)."""
    kids = nodes.where("depth > 0").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    n = cut(nodes.join(kids, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # children are fewer than nodes, so fewer than HOT_NODES nodes have more than 1 / HOT_NODES of them
    hot = F.col("n_children") > max(FEW_CHILDREN, n.count() // HOT_NODES)
    above = n.where("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"), F.col("path").alias("parent_path"), "n_children")
    some = n.join(F.broadcast(above.where(hot).drop("n_children")), ["px", "py"], "left")
    rest = some.where("parent_path is null").drop("parent_conv_id", "parent_path").join(above.where(~hot).drop("n_children"), ["px", "py"], "left")
    return cut(some.where("parent_path is not null").unionByName(rest).drop("px", "py"))


def peel(paths: DataFrame) -> DataFrame:
    """Totals of subtrees of ``paths`` (path, parent_path, saved, leaves): the same columns, each with all that hangs from it.

    A path holds the number of child paths it waits for. Each round, paths that wait for none are complete: they send their totals to their
    parents, whose counters fall by the messages that arrive. Each round's waiting paths are a table of their own.
    """
    waits = paths.where("parent_path is not null").groupBy(F.col("parent_path").alias("path")).agg(F.count("*").alias("waiting"))
    now = cut(paths.join(waits, "path", "left").withColumn("waiting", F.coalesce("waiting", F.lit(0).cast("long"))))
    finished = []
    while True:
        done = now.where("waiting = 0")
        finished.append(done.drop("waiting"))
        sent = done.groupBy(F.col("parent_path").alias("path")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("n"))
        left = now.where("waiting > 0").join(sent, "path", "left")
        now = cut(
            left.select(
                "path", "parent_path", "top", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("waiting") - F.coalesce("n", F.lit(0))).alias("waiting"),
            )
        )
        if now.isEmpty():
            break
    out = finished[0]
    for f in finished[1:]:
        out = out.unionByName(f)
    return out


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Per node of the trie of ``turns`` (conv_id, place from 1 without gaps, a, b, bytes): conv_id (its smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``members`` (conv_id, distinct, not null) has every conversation, those without turns too; they are members of the root alone.
    Without members there is no node.
    """
    rows = cut(prefixes(turns))
    order = F.xxhash64("conv_id")  # one to one on numbers of 64 bits
    found = rows.groupBy("x", "y").agg(
        F.max("place").alias("depth"), F.min("conv_id").alias("conv_id"), F.min(order).alias("path"), F.count("*").alias("n_convs"),
        F.max("bytes").alias("bytes"), F.max("px").alias("px"), F.max("py").alias("py"),
    )
    zero = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.min(order).alias("path"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.withColumns({"x": zero, "y": zero, "depth": zero, "bytes": zero, "px": F.lit(None).cast("long"), "py": F.lit(None).cast("long")})
    nodes = _with_parents(cut(found.unionByName(root)))

    own = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("bytes"), "leaves": (F.col("n_children") == 0).cast("long")})
    is_top = F.col("parent_path").isNull() | (F.col("parent_path") != F.col("path"))
    paths = own.groupBy("path").agg(
        F.max(F.when(is_top, F.col("parent_path"))).alias("parent_path"), F.min("depth").alias("top"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")
    )
    got = peel(paths).where("parent_path is not null").groupBy(F.col("parent_path").alias("path"), (F.col("top") - 1).alias("depth"))
    got = got.agg(F.sum("saved").alias("got_saved"), F.sum("leaves").alias("got_leaves"))
    own = own.join(got, ["path", "depth"], "left")
    own = own.withColumns({v: F.col(v) + F.coalesce(f"got_{v}", zero) for v in ("saved", "leaves")})
    totals = running(own, "path", "depth", ["saved", "leaves"], F.sum, lambda p, q: p + q, down=True)

    last = rows.groupBy("conv_id").agg(F.max_by("x", "place").alias("x"), F.max_by("y", "place").alias("y"))
    ends = members.join(last, "conv_id", "left").select("conv_id", F.coalesce("x", zero).alias("x"), F.coalesce("y", zero).alias("y"))
    ends = ends.repartition("x", "y").sortWithinPartitions("x", "y", "conv_id").mapInPandas(_digests, "x bigint, y bigint, ends_sha256 string")
    return totals.join(ends, ["x", "y"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` (conv_id, turn, role, text) as they are; columns as of ``trie``.

    Order, nulls and rows without an id as in ``numbered_turns``. Repeated rows are turns of their own. Further columns are not
    read. An empty table has no node.
    """
    turns = cut(numbered_turns(conversations))
    return trie(turns, turns.select("conv_id").distinct())
