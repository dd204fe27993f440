"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network.

Words are hashed to ``BUCKETS`` rows. Each row has a sparse random index vector; its context vector is the sum of the
index vectors of all words within ``REACH`` places of it, over every text of the corpus. Partitions add up
their own context vectors and hand on sums, so what is gathered is bounded by the number of partitions and
never by the number of words. A document is the mean of its words' index vectors and of their context vectors. Words come
with marks of their shape (capitals, digits, a word said again), which are words of their own.
A network with one hidden layer is trained on a bounded sample of labelled rows; the temperature that its
logits are divided by is fitted on rows of that sample that it was not trained on.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions
from .labelled import fold, one_label, sample, texts_of

FOLDS, HELD_OUT = 3, 1
#: Bound of the sample that the network is fitted on.
MOST_ROWS = 12_000
THRESHOLD = 0.5
BUCKETS, DIMS, NONZERO, REACH = 1 << 14, 64, 4, 2
PARTS = 64
#: Words whose neighbours are added up at once.
AT_ONCE = 1_000_000
HIDDEN, STEPS, BATCH, RATE, DECAY, SEED = 32, 1_500, 256, 3e-3, 1e-3, 5
WORD = re.compile(r"[^\W\d_]+|\d+|(?:(?!\s)[\W_])+")
GAP = 0  # stands between documents; has no index vector
UPPER, TITLE, DIGITS, SIGNS, AGAIN = "\x01A", "\x01Aa", "\x010", "\x01!", "\x01="
_R = np.random.Generator(np.random.PCG64(71))
PLACE = _R.integers(0, DIMS, (BUCKETS, NONZERO))
SIGN = _R.choice([-1.0, 1.0], (BUCKETS, NONZERO))
SIGN[GAP] = 0
INDEX = np.zeros((BUCKETS, DIMS), np.float32)
np.add.at(INDEX, (np.arange(BUCKETS)[:, None], PLACE), SIGN)


def bucket(word: str) -> int:
    return 1 + zlib.crc32(word.encode()) % (BUCKETS - 1)


class Buckets(dict):
    """What stands between white space → the buckets of its words and of their shapes, as bytes of 16-bit numbers."""

    def __missing__(self, piece: str) -> bytes:
        if len(self) > 400_000:
            self.clear()
        out = []
        for w in WORD.findall(piece):
            out.append(bucket(w.lower()))
            shape = DIGITS if w.isdigit() else SIGNS if not w.isalpha() else UPPER if w.isupper() and len(w) > 1 else TITLE if w[0].isupper() else None
            if shape:
                out.append(bucket(shape))
        out = self[piece] = np.array(out, np.uint16).tobytes()
        return out


def numbers(text: str | None, known: Buckets) -> np.ndarray:
    pieces = text.split() if text else []
    again = sum(map(operator.eq, pieces, pieces[1:]))
    return np.frombuffer(b"".join([known[p] for p in pieces]) + np.uint16(bucket(AGAIN)).tobytes() * again, np.uint16)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, total, between = Buckets(), np.zeros(BUCKETS * DIMS), np.full(REACH, GAP, np.uint16)
    parts, held = [], 0

    def add() -> None:
        nonlocal total, parts, held
        ids = np.concatenate(parts).astype(np.int64)
        for s in range(0, len(ids), AT_ONCE):
            for k in range(1, REACH + 1):
                # pairs of places k apart of which the later one is in this stretch
                first, second = ids[max(0, s - k) : s + AT_ONCE - k], ids[max(0, s - k) + k : s + AT_ONCE]
                first = first[: len(second)]
                for a, b in ((first, second), (second, first)):
                    for j in range(NONZERO):
                        total += np.bincount(a * DIMS + PLACE[b, j], SIGN[b, j], BUCKETS * DIMS)
        parts, held = [], 0

    for pdf in portions(batches):
        for t in pdf["text"]:
            if isinstance(t, str):
                parts += [numbers(t, known), between]
                held += len(parts[-2])
        if held >= AT_ONCE:
            add()
    if parts:
        add()
    rows = total.astype(np.float32).reshape(PARTS, -1)
    yield pd.DataFrame({"part": np.arange(PARTS), "sums": [r.tobytes() for r in rows]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, raw in zip(pdf["part"].tolist(), pdf["sums"], strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64)
            total[part] = total[part] + x if part in total else x
    yield pd.DataFrame({"part": pd.Series(list(total), dtype="int64"), "sums": [x.tobytes() for x in total.values()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x (2 DIMS): index vectors and unit context vectors, from all texts."""
    sums = docs.select("text").mapInPandas(_contexts, "part bigint, sums binary")
    got = sums.repartition(PARTS, "part").mapInPandas(_added, "part bigint, sums binary").toPandas()
    ctx = np.zeros((PARTS, BUCKETS * DIMS // PARTS))
    for part, raw in zip(got["part"].tolist(), got["sums"], strict=True):
        ctx[part] += np.frombuffer(raw, np.float64)
    ctx = ctx.reshape(BUCKETS, DIMS)
    ctx /= np.linalg.norm(ctx, axis=1, keepdims=True) + 1e-9
    return np.hstack([INDEX, ctx]).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray, known: Buckets) -> np.ndarray:
    ids = numbers(text, known)
    out = np.zeros(vectors.shape[1] + 1, np.float32)
    if len(ids):
        for s in range(0, len(ids), 20_000):
            out[:-1] += vectors[ids[s : s + 20_000]].sum(axis=0)
        out /= len(ids)
    out[-1] = np.log1p(len(ids)) / 8
    return out


class Network:
    """x → tanh layer → logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.temperature, self.share = 1.0, float(y.mean()) if len(y) else 0.5
        self.p: list[np.ndarray] = []
        if len(np.unique(y)) < 2:
            return
        order = rng.permutation(len(y))
        test, train = order[: len(y) // 5], order[len(y) // 5 :]
        z, d = (x - self.mean) / self.scale, x.shape[1]
        self.p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        for t in range(1, STEPS + 1):
            at = rng.choice(train, min(BATCH, len(train)), replace=False)
            h = np.tanh(z[at] @ self.p[0] + self.p[1])
            e = (1 / (1 + np.exp(-np.clip(h @ self.p[2] + self.p[3], -30, 30))) - y[at]) / len(at)
            eh = np.outer(e, self.p[2]) * (1 - h * h)
            for i, g in enumerate([z[at].T @ eh, eh.sum(axis=0), h.T @ e, e.sum(keepdims=True)]):
                g = g + DECAY * self.p[i] * (i in (0, 2))
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        if len(test):
            f = self.logit(x[test])
            self.temperature = min(np.geomspace(0.25, 20, 60).tolist(), key=lambda c: float(np.logaddexp(0, np.where(y[test] == 1, -f, f) / c).mean()))

    def logit(self, x: np.ndarray) -> np.ndarray:
        if not self.p:
            return np.full(len(x), np.log((self.share * 0.98 + 0.01) / (1 - self.share * 0.98 - 0.01)))
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def pool(docs: DataFrame, vectors: np.ndarray, keep: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets()
        for pdf in portions(batches):
            yield pd.DataFrame({keep: pdf[keep], "x": [pooled(t if isinstance(t, str) else None, vectors, known).tobytes() for t in pdf["text"]]})

    return docs.select(keep, "text").mapInPandas(run, f"{keep} int, x binary")


def quality(docs: DataFrame, labels: DataFrame, *, most_rows: int = MOST_ROWS, threshold: float = THRESHOLD, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Labels of the held-out fold are not read into the fit. Null and empty texts get the score of a text without words.
    With labels of one class only (or none) every score is that class's share. Rows that share an id
    are scored each for itself; a null id is in no fold held out. Texts of any length are read whole. Further columns are not
    read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    train = one_label(labels, "quality").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    got = pool(texts_of(docs, sample(train, most_rows, seed)), vectors, "y").toPandas()
    x = np.array([np.frombuffer(r, np.float32) for r in got["x"]], np.float64).reshape(-1, vectors.shape[1] + 1)
    net = Network(x[np.lexsort(x.T)], got["y"].to_numpy(float)[np.lexsort(x.T)], seed)
    shared = spark.sparkContext.broadcast((vectors, net))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Buckets()
        table, network = shared.value
        for pdf in portions(batches):
            rows = np.array([pooled(t if isinstance(t, str) else None, table, known) for t in pdf["text"]], np.float64).reshape(len(pdf), -1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": network.score(rows) if len(pdf) else np.empty(0)})

    s = docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, score double")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


