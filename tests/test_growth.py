"""What decides how the time and memory of single queries grow."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from litweave import storage
from litweave.operators import modeling, textmining
from litweave.operators import vertices as V
from litweave.plans import catalog, reviews
from litweave.plans.queries import QUERIES

TWO = [("x", "a", "b", 2.0), ("x", "b", "c", 1.0), ("x", "a", "c", 1.0), ("y", "d", "e", 1.0)]


def test_summary_takes_communities_only(spark, tmp_path, monkeypatch):
    edges = storage.hold(spark.createDataFrame(TWO, "network string, a string, b string, weight double"))
    for module in (catalog, reviews):
        monkeypatch.setattr(module, "networks", lambda s, d: edges)
    for unused in ("betweenness", "closeness", "pagerank", "core_numbers"):
        monkeypatch.setattr(V, unused, None)
    was = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    got = {r["network"]: r for r in QUERIES["g01_network_summary_kernels"](spark, str(tmp_path)).collect()}
    assert (got["x"]["nodes"], got["x"]["edges"], got["x"]["components"], got["y"]["nodes"]) == (3, 3, 1, 2)
    assert was == (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.shuffle.partitions"))


def test_rounds_have_a_session_of_their_size(spark):
    held = storage.hold(spark.range(10))
    few = storage.in_rounds(held, 10)
    assert few.sparkSession.conf.get("spark.sql.shuffle.partitions") == "1" and few.count() == 10
    assert storage.in_rounds(held, storage.MANY_ROWS) is held


def test_equal_titles_and_names_are_looked_for_once(spark, monkeypatch):
    from litweave.operators import ledgers

    tables = []
    monkeypatch.setattr(ledgers, "hold", lambda df: tables.append(storage.hold(df)) or tables[-1])
    long, short = "a long title about the growth of joins in tables of copies", "growth"
    r = spark.createDataFrame([(i, long if i % 2 else short) for i in range(40)], "record_id long, title string")
    f = spark.createDataFrame([(f"p{i:02}", "title about the growth" if i % 2 else "why growth of joins matters") for i in range(40)], "path string, stem string")
    got = {x["record_id"]: x["path"] for x in ledgers.best_fulltexts(r, f).collect()}
    assert got == {i: "p39" if i % 2 else "p38" for i in range(40)}
    assert sorted(t.count() for t in tables) == [1, 2, 2, 40]


def test_tokens_of_a_model_are_made_once(spark, tmp_path):
    """Rows that share an id are one row of the term matrix, and of what they hold nothing is lost."""
    made = str(tmp_path / "made")

    def cut(batches):
        for pdf in batches:
            with open(made, "a") as f:
                f.write("x" * len(pdf))
            yield pdf.assign(tokens=[t.split() for t in pdf["text"]]).drop(columns="text")

    texts = [(i, f"alpha w{i % 5} w{i % 7}") for i in range(30)] + [(30, "w1 w2"), (30, "w3 w4"), (31, "none")]
    docs = spark.createDataFrame(texts, "record_id long, text string").mapInPandas(cut, "record_id long, tokens array<string>")
    m = modeling.Matrix.of(docs, "tokens")
    got = {r["record_id"]: {m.terms[a]: w for a, w in zip(r["at"], r["weight"], strict=True)} for r in m.rows.collect()}
    assert len(open(made).read()) == len(texts)
    assert m.n == len(got) == 31 and set(got[30]) >= {"w1", "w2", "w3", "w4"} and m.terms == sorted(m.terms)
    assert all(abs(sum(w * w for w in x.values()) - (2 if i == 30 else 1)) < 1e-9 for i, x in got.items())
    want = textmining.tfidf(docs, "tokens", digits=9).where("record_id < 30").collect()
    assert len(want) == sum(len(x) for i, x in got.items() if i < 30)
    assert all(abs(got[r["record_id"]][r["term"]] - r["weight"]) < 2e-9 for r in want)


def test_numbered_grams_are_those_of_rows(monkeypatch):
    monkeypatch.setattr(textmining, "MOST_TOKENS", 40)
    r = random.Random(5)
    rows = [[f"w{r.randrange(6)}" for _ in range(r.choice([0, 1, 2, 9, 60]))] for _ in range(50)] + [None, []]
    lists = pa.array(rows, pa.list_(pa.string())).slice(3)
    for low, high, frequent in ((1, 1, None), (1, 3, None), (2, 4, {"w1", "w2", "w5"}), (1, 3, {"w0", "w3"}), (1, 2, set())):
        got = [Counter() for _ in range(len(lists))]
        for first, some in textmining.portions(lists):
            for names, row, number in textmining.numbered_grams(some, low, high, None if frequent is None else pa.array(sorted(frequent), pa.string())):
                for i, n in zip(row, number, strict=True):
                    got[first + i][names[int(n)].as_py()] += 1
        assert got == [Counter(textmining.grams(t or [], low, high, frequent)) for t in rows[3:]]


def test_fits_that_move_together_move_as_alone():
    r = np.random.default_rng(1)
    z, sets = r.normal(size=(40, 6)), [r.normal(size=(k, fits, 6)) for k, fits in ((2, 3), (5, 4), (1, 2))]
    sets[1][3, 0] = sets[1][0, 0]  # a tie
    sums, sizes, losses = [], [], []
    for c in sets:
        d = ((z[:, None, None, :] - c[None]) ** 2).sum(axis=3)
        own = np.arange(len(c))[None, :, None] == d.argmin(axis=1)[:, None, :]
        sums.append(np.einsum("nkf,nd->kfd", own, z).ravel())
        sizes.append(own.sum(axis=0).ravel())
        losses.append(d.min(axis=1).sum(axis=0))
    assert np.allclose(modeling.moved(z, sets), np.concatenate([*sums, *sizes, *losses]))


def test_merged_partitions_are_bounded_where_there_are_many(spark, sf, monkeypatch):
    from litweave.plans import adapters

    merged = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(adapters, "PART_BYTES", 1 << 12)
    try:
        spark.conf.unset(merged)
        spark.conf.set("spark.sql.shuffle.partitions", 100_000)
        adapters.table(spark, sf, "lineitem")
        assert spark.conf.get(merged) == f"{1 << 12}b" and spark.conf.get("spark.sql.shuffle.partitions") == "100000"
        spark.conf.set(merged, "1k")  # a size that is set stays
        adapters.table(spark, sf, "lineitem")
        assert spark.conf.get(merged) == "1k"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(merged)
