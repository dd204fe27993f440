"""The backoff automaton against the model's formulas over plain dictionaries, whatever the blocks, buckets and stretches."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from litweave.llm import backoff

SCHEMA = "doc_id long, text string, held boolean, score double, row string"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


class Plain:
    def __init__(self, texts):
        self.c = {1: Counter(), 2: Counter(), 3: Counter()}
        for t in texts:
            ts = [None, *tokens(t)]
            for i in range(1, len(ts)):
                self.c[1][ts[i]] += 1
                self.c[2][ts[i - 1], ts[i]] += 1
                if i > 1:
                    self.c[3][ts[i - 2], ts[i - 1], ts[i]] += 1
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        clip = lambda x: min(max(x, 0.1), 0.9)
        count = lambda n, k: sum(x == k for x in self.c[n].values())
        self.d = clip(count(1, 1) / max(self.v, 1))
        self.D = clip(count(2, 1) / max(count(2, 1) + 2 * count(2, 2), 1))
        self.arcs = {g: n for g, n in self.c[3].items() if n >= 2}
        self.next2, self.next3 = Counter(g[0] for g in self.c[2]), Counter(g[:2] for g in self.arcs)
        self.sum3 = Counter()
        for g, n in self.arcs.items():
            self.sum3[g[:2]] += n

    def p1(self, w):
        if not self.n:
            return 1.0
        return (self.c[1][w] - self.d if self.c[1][w] else self.d * self.v) / self.n

    def p2(self, u, w):
        c = self.c[1][u]
        return (max(self.c[2][u, w] - self.D, 0) + self.D * self.next2[u] * self.p1(w)) / c if c else self.p1(w)

    def p3(self, u, v, w):
        c, k = self.c[2][u, v], self.next3[u, v]
        if not k:
            return self.p2(v, w)
        return (max(self.arcs.get((u, v, w), 0) - self.D, 0) + (c - self.sum3[u, v] + self.D * k) * self.p2(v, w)) / c

    def score(self, text):
        ts = [None, *tokens(text)]
        return sum(math.log10(self.p2(*ts[:2]) if i == 1 else self.p3(*ts[i - 2 : i + 1])) for i in range(1, len(ts)))

    def base(self, text):
        return sum(math.log10((self.c[1][t] + 1) / (self.n + self.v + 1)) for t in tokens(text))


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    text = lambda n: r.choice([" ", "\n", "\t "]).join(r.choice("abcdefgHIJKé漢") * r.choice([1, 1, 2]) for _ in range(n))
    texts = [text(r.choice([0, 1, 2, 5, 40, 90])) for _ in range(90)]
    texts += [texts[-1]] * 9 + [None, "", " \x0b ", "\x1c one\x85two three", "never seen words here", text(1500), text(1500)]
    return [(i, t, True, 0.5, "x") for i, t in enumerate(texts)] + [(None, "no id a b", False, None, "y"), (7, "a b", None, None, None), (7, "a b", None, None, None)]


def check(spark, rows, parts):
    got = sorted((tuple(r) for r in backoff.log_probabilities(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()), key=str)
    model = Plain([r[1] for r in rows if not is_held(r[0])])
    want = []
    for i, text, *_ in rows:
        ts = tokens(text)
        want.append((i, is_held(i), len(ts), sum(model.c[1][t] > 0 for t in ts), model.n, model.base(text), model.score(text)))
    want.sort(key=str)
    assert sorted(map(str, (g[:5] for g in got))) == sorted(map(str, (w[:5] for w in want)))
    for k in (5, 6):
        assert np.allclose(sorted(g[k] for g in got), sorted(w[k] for w in want), rtol=1e-9)
    for i in {w[0] for w in want if w[0] != 7}:
        assert np.allclose([g[5:] for g in got if g[0] == i], [w[5:] for w in want if w[0] == i], rtol=1e-9)
    return model


def test_scores_are_those_of_the_formulas(spark, rows):
    model = check(spark, rows, 3)
    every = [*model.c[1], "word that is not there"]
    for u, v in [("a", "b"), (None, "a"), ("zz", "a"), ("a", "zz"), *list(model.next3)[:40]]:
        assert math.isclose(sum(model.p3(u, v, w) for w in every), 1)


def test_blocks_buckets_and_stretches_change_nothing(spark, rows, monkeypatch):
    for name, value in (("TOKENS", 50), ("PER_BUCKET", 40), ("STRETCH", 7), ("BYTES", 11)):
        monkeypatch.setattr(backoff, name, value)
    monkeypatch.setattr("litweave.llm.backoff.LEAST_SHARE", 0.0)
    check(spark, rows, 4)


def test_no_texts_and_no_training_texts(spark):
    assert backoff.log_probabilities(spark.createDataFrame([], SCHEMA)).collect() == []
    i = next(i for i in range(100) if is_held(i))
    (r,) = backoff.log_probabilities(spark.createDataFrame([(i, "a b a", None, None, None)], SCHEMA)).collect()
    assert tuple(r) == (i, True, 4, 0, 0, 0.0, 0.0)


def test_packed_numbers():
    for a in ([], [1, 1], [0, 1], [255], [256], [70_000, 0], [2**40]):
        assert backoff.unpacked(backoff.packed(np.array(a, np.int64)), len(a)).tolist() == a


def test_words_of_long_texts(monkeypatch):
    monkeypatch.setattr(backoff, "BYTES", 3)
    text = "ab  Cde\nf ghijklmnop é\x85x  "
    assert [w for part in backoff.words_of(text) for w in part] == text.lower().encode().split()


def test_copies_of_training_texts_score_above_others(spark):
    r = random.Random(2)
    fresh = lambda: " ".join(f"w{r.randrange(300)}" for _ in range(60))
    rows = [(i, fresh()) for i in range(300)]
    rows += [(500 + i, t) for i, t in rows if not is_held(500 + i)]
    held = [i for i in range(1_000, 1_100) if is_held(i)]
    rows += [(i, rows[k][1] if k % 2 and not is_held(k) and not is_held(500 + k) else fresh()) for k, i in enumerate(held)]
    got = pd.DataFrame([x.asDict() for x in backoff.log_probabilities(spark.createDataFrame(rows, "doc_id long, text string")).collect()]).set_index("doc_id")
    own = lambda odd: [got.loc[i, "score"] for k, i in enumerate(held) if (k % 2 and not is_held(k) and not is_held(500 + k)) == odd]
    assert min(own(True)) > max(own(False)) + 30
