"""Divergence of sources against plain Python integers, on ties, nulls, languages without terms and hot vectors."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from litweave.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank int, value string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    docs, groups = defaultdict(list), set()
    for _, text, lang, source, *_ in rows:
        docs[lang or ""].append((source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))))
        groups.add((lang or "", source or ""))
    out = set()
    for lang, own in docs.items():
        df = Counter(t for _, ts in own for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= dv.LEAST_DOCS)
        n = {s: Counter() for g, s in groups if g == lang}
        for s, ts in own:
            n[s].update(t for t in ts if df[t] >= dv.LEAST_DOCS)
        everywhere = sum(n.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        ps, q = {s: p(c) for s, c in n.items()}, p(everywhere)
        f = lambda a, b: (a - b) ** 2 // b
        for s in n:
            pairs = sorted((-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in n if o != s)
            words = sorted((-f(ps[s][t], q[t]), t.encode()) for t in kept if n[s][t] and ps[s][t] > q[t])[: dv.RANKS]
            for part, ranked in (("pair", pairs), ("term", words)):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(ranked, 1)}
    return out


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("Ab", "é", "漢", "x", "Zz") for b in ("", "q", "ß", "Äö", "kk", "ÉE")]
    out = []
    for i in range(160):
        ws = [r.choice(vocabulary) + r.choice(["", " ", "1", "-", "\x7f"]) for _ in range(r.choice([0, 3, 20]))]
        out.append((i, " ".join(ws), r.choice(["en", "de"]), r.choice(["s0", "s0", "s1", "S1", "é"]), "t", 1, "v"))
    out += [(200 + i, None if i == 0 else " ".join(f"w{c}{chr(97 + i % 3)}" for c in "abcdefghijklmnopqrst" for _ in range(i)), None, None if i % 2 else "own", "t", 1, "v") for i in range(8)]
    out += [(300, "only here", "fr", "s0", "t", 1, "v"), (301, "", "fr", "s1", "t", 1, "v"), out[0], out[0]]
    return out


def test_divergence_is_that_of_plain_python(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows)
    assert {x[2] for x in want} == {"pair", "term"} and ("fr", "s0", "pair", "s1", 0, 1) in want
    assert found(dv.divergence(df.repartition(3))) == want
    monkeypatch.setattr(dv, "RANKS", 5)
    assert found(dv.divergence(df.repartition(1))) == plain(rows)


def test_no_documents(spark):
    assert dv.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "a b", "en", "s", "t", 1, "v")], SCHEMA)
    assert dv.divergence(one).collect() == []  # no other source, no term in three documents


def test_few_terms_are_held_and_no_count_is_lost(monkeypatch):
    import pandas as pd

    batch = pd.DataFrame({"text": ["a b c a", "b", "", "d A"], "lang": ["x"] * 4, "source": ["s", "s", "t", "t"]})
    whole = pd.concat(dv._counts(iter([batch, batch])))
    monkeypatch.setattr(dv, "TERMS_HELD", 1)
    parts = list(dv._counts(iter([batch, batch])))
    assert len(parts) > 2
    add = lambda d: {k: (r.n, r.docs) for k, r in d.groupby(["source", "term"])[["n", "docs"]].sum().iterrows()}
    assert add(pd.concat(parts)) == add(whole) and add(whole)["s", "a"] == (4, 2)


def test_shares_are_exact_and_sums_come_in_portions(monkeypatch):
    r = np.random.default_rng(1)
    n = r.integers(0, 10**13, 2000)
    of = n + 1 + r.integers(0, 10**13, 2000)
    assert dv.shares(n, of).tolist() == [1 + 10**9 * (a + 1) // b for a, b in zip(n.tolist(), of.tolist(), strict=True)]
    sids, ns = [np.array(x) for x in ([0, 2], [1], [0, 1, 2])], [np.array(x) for x in ([3, 1], [5], [1, 1, 1])]
    of = np.array([40, 50, 60])

    def total():
        s, out = dv.PairSums("en", of), {}
        for pdf in [*s.add(sids, ns, np.array([2, 1, 7])), *s.take()]:
            for x in pdf.itertuples():
                out[x.a, x.b] = out.get((x.a, x.b), 0) + x.more
        return out

    whole = total()
    monkeypatch.setattr(dv, "CELLS", 3)
    assert total() == whole
