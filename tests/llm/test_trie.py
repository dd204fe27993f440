"""The prefix trie against plain Python, on ties, nulls, copies, long and turnless conversations."""

import hashlib
import random
import zlib

import pytest

from litweave.llm import prefix_trie as pt
from litweave.llm.op12 import rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth long, x string, place string"


def plain(ways):
    """Nodes of {conv_id: [(role, text), ...]} by brute force."""
    members, out = {}, {}
    for c, way in ways.items():
        for d in range(len(way) + 1):
            members.setdefault(tuple(way[:d]), []).append(c)
    for node, of in members.items():
        below = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        children = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members) for n in below)
        ends = ",".join(map(str, sorted(c for c in of if len(ways[c]) == len(node))))
        out[min(of), len(node)] = (min(members[node[:-1]]) if node else None, len(of), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def whole(rows):
    ways = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).hexdigest())):
        ways.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return ways


def mixed_up(ways):
    out = {}
    for c, own in ways.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = ways.get(c - c % 5, [])[:h] + own[h:]
    return out


def found(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for c in range(60):
        for i in range(rng.choice([1, 1, 2, 3, 5, 12])):
            out.append((c, rng.choice([None, i, i, 3]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é漢", "", None]), 1, "x", "y"))
    out += [(100 + c, i, "user", f"t{i}", 1, "x", "y") for c in range(40) for i in range(c // 2 + 1)]  # snapshots of a growing conversation
    out += [(None, 1, "user", "no id", 1, "x", "y"), (3, 1, "user", "a", 1, "x", "y"), (3, 1, "user", "a", 1, "x", "y"), (-7, 0, None, None, 1, "x", "y")]
    return out


def test_trie_is_that_of_plain_python(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(pt.prefix_trie(df)) == plain(whole(rows))


def test_trie_of_rebuilt_conversations(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = plain(mixed_up(whole(rows)))
    assert found(pt.trie(*rebuilt(pt.numbered_turns(df)))) == want
    # chunks of three places, and every parent of more than two children by broadcast
    monkeypatch.setattr(pt, "CHUNK", 3)
    monkeypatch.setattr(pt, "FEW_CHILDREN", 2)
    monkeypatch.setattr(pt, "HOT_NODES", 10**6)
    monkeypatch.setattr("litweave.llm.op12.CHUNK", 3)
    assert found(pt.trie(*rebuilt(pt.numbered_turns(df)))) == want


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pt.prefix_trie(none).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "user", "a", 1, "x", "y")], SCHEMA)).collect() == []


def test_ids_of_a_node_may_come_in_many_batches():
    import pandas as pd

    batches = [pd.DataFrame({"x": [1, 1], "y": [0, 0], "conv_id": [5, 6]}), pd.DataFrame({"x": [1, 1, 2], "y": [0, 1, 1], "conv_id": [7, 8, 9]})]
    got = {(r.x, r.y): r.ends_sha256 for b in pt._digests(iter(batches)) for r in b.itertuples()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, 0): sha("5,6,7"), (1, 1): sha("8"), (2, 1): sha("9")}
