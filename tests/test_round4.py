"""Cases of the fourth round's findings."""

import datetime
import random

import pandas as pd
import pytest

from litweave.plans.queries import ORACLE_SQL, QUERIES


def put(folder, **tables):
    """Single files, as both engines read them."""
    for name, t in tables.items():
        t.to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    return str(folder)


def sql_rows(folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "part"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con.execute(ORACLE_SQL[name]).fetchall()


def works_of(folder, authors):
    orders = pd.DataFrame([(i, datetime.datetime(2000 + i % 9, 1, 1), "F", "1-URGENT", 1000.0 + i) for i in range(len(authors))], columns=["o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    lines = pd.DataFrame([(i, a % 5, a) for i, x in enumerate(authors) for a in x], columns=["l_orderkey", "l_partkey", "l_suppkey"])
    return put(folder, orders=orders, lineitem=lines, part=pd.DataFrame([(i, f"word{i} thing", "TYPE", i + 1) for i in range(5)], columns=["p_partkey", "p_name", "p_type", "p_size"]))


def test_participation_is_that_of_all_authors(spark, tmp_path):
    """More than 100 authors of a work, 250 nodes and 3,000 edges."""
    r = random.Random(7)
    d = works_of(tmp_path, [sorted(r.sample(range(400), r.randrange(2, 7))) for _ in range(600)] + [list(range(150))])
    got = sorted(map(tuple, QUERIES["g01_participation"](spark, d).collect()))
    want = sorted(sql_rows(d, "g01_participation"))
    assert "limit" not in ORACLE_SQL["g01_participation"] and len(got) > 380
    assert [x[:2] for x in got] == [x[:2] for x in want]
    for g, w in zip(got, want, strict=True):
        assert g[2:] == pytest.approx(w[2:], abs=2e-6)


def test_betweenness_is_that_of_all_citations(spark, sf):
    """Brandes' sums in plain loops, over more than the 250 nodes of a backbone."""
    o, lines = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("orders", "lineitem"))
    known = set(o["o_orderkey"])
    out = {}
    for a, b in zip(lines["l_orderkey"].tolist(), lines["l_partkey"].tolist(), strict=True):
        if b in known and a != b:
            out.setdefault(a, set()).add(b)
    want = dict.fromkeys({*out, *(b for x in out.values() for b in x)}, 0.0)
    for s in out:
        ways, before, order, level = {s: 1.0}, {}, [], [s]
        while level:
            order += level
            new = {}
            for v in level:
                for w in out.get(v, ()):
                    if w not in ways:
                        new[w] = new.get(w, 0) + ways[v]
                        before.setdefault(w, []).append(v)
            ways |= new
            level = list(new)
        behind = dict.fromkeys(order, 0.0)
        for w in order[:0:-1]:
            for v in before[w]:
                behind[v] += ways[v] / ways[w] * (1 + behind[w])
            want[w] += behind[w]
    n = len(want)
    assert n > 1000
    got = {x["record_id"]: x["betweenness"] for x in QUERIES["g04_directed_betweenness"](spark, sf).collect()}
    assert got.keys() == want.keys() and [got[k] for k in want] == pytest.approx([v / ((n - 1) * (n - 2)) for v in want.values()], abs=2e-6)


def test_betweenness_does_not_depend_on_batches(spark, monkeypatch):
    from litweave.operators import graphs, vertices

    r = random.Random(4)
    e = spark.createDataFrame([(r.randrange(40), r.choice([3, r.randrange(40)])) for _ in range(160)], "source_id long, target_id long")
    want = graphs.directed_betweenness(e).collect()
    monkeypatch.setattr(vertices, "PART", 4)  # several parts of a node
    assert sorted(graphs.directed_betweenness(e, batch=15).collect()) == sorted(want) and max(x["betweenness"] for x in want) > 0


def test_random_graphs_are_drawn_for_networks_of_any_size(spark):
    from litweave.operators import vertices

    ring = spark.createDataFrame([("x", str(i), str((i + k) % 5_200), 1.0) for i in range(5_200) for k in (1, 2)], "network string, a string, b string, weight double")
    r = vertices.sensitivity(ring, levels=(1,), runs=2).first()
    assert (r["nodes"], r["edges"], r["clustering"], r["null_runs"]) == (5_200, 10_400, 0.5, 2) and 0 <= r["null_mean"] < 0.01 and r["null_z"] > 10


def plain_runs(texts):
    from collections import Counter

    from litweave.operators.modeling import cut_grams

    cf, df = Counter(), Counter()
    for t in texts:
        own = Counter(cut_grams(t or ""))
        cf.update(own)
        df.update(own.keys())
    return {x: (df[x], cf[x]) for x in cf}


@pytest.mark.parametrize("most", [200_000, 40])
def test_runs_of_letters_are_counted_by_numbers(spark, monkeypatch, most):
    """Texts are not cut one by one; with few terms at a time nothing is lost."""
    from litweave.operators import textmining

    r = random.Random(2)
    texts = ["".join(r.choice("abcdé一  \t\n\x00") for _ in range(r.randrange(90))) for _ in range(150)] + ["", None, "a", " \n ", "\x00\x00 a\x00"]
    monkeypatch.setattr(textmining, "MOST_COUNTED", most)
    rows = [x for batch in textmining_batches(textmining, texts, None) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    assert added(rows) == plain_runs(texts)


def test_runs_of_more_characters_than_codes(spark, monkeypatch):
    from litweave.operators import textmining
    from litweave.operators.modeling import cut_grams

    monkeypatch.setattr(textmining, "CODE_BITS", 3)
    monkeypatch.setattr(textmining, "MOST_TOKENS", 12)
    texts = ["abc abd", "aecd fgh", "ijk lm", "abc defghi jkl", "abcd"]
    rows = [x for batch in textmining_batches(textmining, texts, cut_grams) for x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
    assert added(rows) == plain_runs(texts)


def textmining_batches(textmining, texts, cut):
    import pyarrow as pa

    def never(text):
        raise AssertionError(text)

    class Docs:
        """What a task of ``term_counts`` is given."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.batches = list(run([pa.RecordBatch.from_arrays([pa.array(some, pa.string())], ["t"]) for some in (texts[:7], texts[7:])]))
            return self

        groupBy = agg = select

    docs = Docs()
    textmining.term_counts(docs, "t", 1, 1, None, cut or never)
    return docs.batches


def added(rows):
    out = {}
    for x, df, cf in rows:
        before = out.get(x, (0, 0))
        out[x] = (before[0] + df, before[1] + cf)
    return out


def test_rows_of_runs(spark):
    from collections import Counter

    from litweave.operators import modeling

    r = random.Random(3)
    texts = {i: " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 6))) for _ in range(r.randrange(30))) for i in range(120)}
    m = modeling.Matrix.of(spark.createDataFrame(list(texts.items()), "record_id long, letters string"), "letters", high=1, cut=modeling.cut_grams, most_features=60)
    want = {i: Counter(x for x in modeling.cut_grams(t) if x in m.terms) for i, t in texts.items()}
    got = {x["record_id"]: x for x in m.rows.collect()}
    assert len(m.terms) == 60 and got.keys() == {i for i, c in want.items() if c}
    for i, x in got.items():
        assert [m.terms[a] for a in x["at"]] == sorted(want[i]) and sum(w * w for w in x["weight"]) == pytest.approx(1)


def test_pairs_are_counted_where_their_record_is(spark):
    """What is shuffled is lists of records by reference; pairs are not."""
    from collections import Counter
    from itertools import combinations

    from litweave.operators import networks

    r = random.Random(6)
    refs = {i: [r.randrange(12) for _ in range(r.randrange(5))] + [99] for i in range(40)}
    found = networks.bibliographic_coupling(spark.createDataFrame(list(refs.items()), "record_id long, refs array<long>"), block=3)
    want = Counter((a, b) for ref in {x for v in refs.values() for x in v} for a, b in combinations(sorted(i for i, v in refs.items() if ref in v), 2))
    assert {(x["record_a"], x["record_b"]): x["shared_references"] for x in found.collect()} == want
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in x]
    assert exchanges and not any("record_a" in x and "record_b" in x for x in exchanges)
