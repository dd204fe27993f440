"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the documents of the training folds, whatever they are, are the
unlabelled set. The risk of a classifier g with loss l and class prior p is
``p E_pos[l(g, +)] + max(0, E_unl[l(g, -)] - p E_pos[l(g, -)])``: the second part estimates the risk on clean
text and is kept from falling below zero, where it would reward overfitting. The prior is the share of toxic
documents among the labelled rows of the training folds.

Features are words and word beginnings of 5 and 7 letters, present or not, of the whole text. Those that
enough positives have are the columns. One pass turns every text into its columns, many texts to a row of a small table; each
step of the fit is one further pass over that table, in which the tasks add up their rows' losses and gradients, and
the scores are a last one. So no unlabelled text is left out, every text is parted into words once, and what reaches the driver is a
few vectors of sums.

The rows are dealt into ``PARTS`` parts. In the same passes as the model further classifiers are fitted, each without the rows of its
own part. The threshold is given, so the bias is set for it, on scores that each row gets
from the classifier that has not seen it: recall r is the share of positives at or above the threshold, q that of
all rows, s the share of toxic rows, and of the shifts of the bias whose estimated F1,
``2 min(s r, q) / (s + q)``, is about the largest, the middle is taken. The model's bias is
then set so that the same share of all rows is at or above the threshold. Flagging every row has an estimated F1 of
``2 s / (1 + s)``: where no shift is clearly better than that, or where a part has fewer than ENOUGH confirmed rows to tell, the share
that is to be flagged is the prior. In no case is it more than MOST_OVER times the prior.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut, cut, named, portions, unused
from .labelled import fold, one_label, sample, seeded, texts_of

FOLDS, HELD_OUT = 4, 2
#: Bounds of the sample of confirmed rows and of the columns (the most frequent in it).
MOST_POSITIVE, MOST_COLUMNS = 4_000, 1 << 15
THRESHOLD = 0.3
LEAST_POSITIVE = 3
STEPS, RATE, DECAY, SEED = 48, 0.12, 3e-4, 11
PARTS = 2
#: Tasks that add up what other tasks have added up.
ADDERS = 4
SHIFTS, NEAR_BEST = np.arange(-8.0, 8.0625, 0.0625), 0.02
#: Confirmed rows of a part from which on its F1 is believed; by how much it is to exceed that of flagging all; bound of the flagged share, in priors.
ENOUGH, CLEARLY, MOST_OVER = 20, 0.1, 2.0
BLOCK, BLOCKS = ["part", "ids", "lengths", "at"], "part int, ids array<bigint>, lengths binary, at binary"
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[int]:
    out = [zlib.crc32(word.encode())]
    out += [zlib.crc32(f"{word[:n]}*".encode()) for n in (5, 7) if len(word) > n]
    return out


class Known(dict):
    """Word → its features, or what those of them that are in ``some`` stand for there."""

    def __init__(self, some: dict[int, object] | None = None) -> None:
        self.some = some

    def __missing__(self, word: str) -> tuple:
        if len(self) > 400_000:
            self.clear()
        out = self[word] = tuple(features(word)) if self.some is None else tuple(self.some[f] for f in features(word) if f in self.some)
        return out


def of_text(text: str | None, known: Known) -> set:
    return set().union(*map(known.__getitem__, set(LETTERS.findall(text.lower())))) if isinstance(text, str) else set()


class Rows:
    """Rows of 0/1 features: the numbers of each row's columns, one after the other, and how many each row has."""

    def __init__(self, at: np.ndarray, lengths: np.ndarray, width: int) -> None:
        self.n, self.width, self.at = len(lengths), width, at
        self.of = np.repeat(np.arange(self.n), lengths)

    @classmethod
    def of_lists(cls, rows: list[np.ndarray], width: int) -> Rows:
        return cls(np.concatenate(rows) if rows else np.empty(0, np.int64), np.array([len(r) for r in rows], np.int64), width)

    def only(self, number: np.ndarray) -> Rows:
        """The same rows with the columns that have a new number of 0 or more."""
        at = number[self.at]
        kept = at >= 0
        return Rows(at[kept], np.bincount(self.of[kept], minlength=self.n), int(number.max(initial=-1)) + 1)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, w[self.at], self.n) if len(self.at) else np.zeros(self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, g[self.of], self.width) if len(self.at) else np.zeros(self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def logit(score: float) -> float:
    return float(np.log(score / (1 - score))) if 0 < score < 1 else np.inf if score >= 1 else -np.inf


def as_clean(rows: Rows, w: np.ndarray, b: float) -> np.ndarray:
    """[number of rows, sum of l(g, -), its derivative by the bias, by each weight] over rows."""
    s = sigmoid(rows.dot(w) + b)
    return np.concatenate([[rows.n, -np.log1p(-np.clip(s, 0, 1 - 1e-9)).sum(), s.sum()], rows.back(s)])


def risk(positive: Rows, unlabelled: np.ndarray, prior: float, w: np.ndarray, b: float) -> tuple[float, float, np.ndarray]:
    """(risk on toxic text, estimated risk on clean text, gradient of the non-negative risk by bias and weights).

    ``unlabelled`` is what ``as_clean`` adds up to. Where the risk on clean text falls below zero the step goes back up it.
    """
    s = sigmoid(positive.dot(w) + b)
    toxic = prior * -np.log(np.clip(s, 1e-300, 1)).mean()
    clean = unlabelled[1] / unlabelled[0] + prior * np.log1p(-np.clip(s, 0, 1 - 1e-9)).mean()
    on_clean = unlabelled[2:] / unlabelled[0] - prior / positive.n * np.concatenate([[s.sum()], positive.back(s)])
    if clean < 0:
        return toxic, clean, -on_clean
    return toxic, clean, on_clean + prior / positive.n * np.concatenate([[(s - 1).sum()], positive.back(s - 1)])


class Fit:
    """One classifier, its weights and bias moved by Adam down the non-negative PU risk."""

    def __init__(self, positive: Rows, seen: np.ndarray, n: float, prior: float) -> None:
        self.positive, self.prior, self.t = positive, prior, 0
        self.able = bool(positive.n and n)
        # a feature as common in unlabelled text as in toxic text starts with nothing
        rate = (positive.back(np.ones(positive.n)) + 0.5) / (positive.n + 1), (seen + 0.5) / (n + 1)
        self.scale = np.concatenate([[1.0], np.clip(np.log(rate[0] / rate[1]), 0, 4) / 4 * self.able])
        self.x = np.concatenate([[np.log(prior / (1 - prior))], np.zeros(positive.width)])
        self.m, self.v = np.zeros_like(self.x), np.zeros_like(self.x)

    def model(self) -> np.ndarray:
        """[bias, weights]."""
        return self.x * self.scale

    def step(self, unlabelled: np.ndarray, steps: int) -> None:
        """One step, from the sums of ``as_clean`` over the unlabelled rows."""
        if not self.able:
            return
        self.t += 1
        now = self.model()
        g = risk(self.positive, unlabelled, self.prior, now[1:], now[0])[2] * self.scale + DECAY * np.concatenate([[0.0], self.x[1:]])
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.99 * self.v + 0.01 * g * g
        rate = RATE * (1 - 0.9 * self.t / steps)
        self.x = self.x - rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def best_shift(positive: np.ndarray, found: np.ndarray, n: float, share: float, threshold: float) -> float | None:
    """The middle of the shifts of the bias, of SHIFTS, whose estimated F1 is within NEAR_BEST of the largest and that hang together with it.

    ``positive`` are logits of confirmed rows; under shift k ``found[k]`` of n rows are at or above the threshold, and a
    ``share`` of all rows is toxic. 0 without rows, None where no shift is clearly better than flagging all rows.
    """
    if not len(positive) or not n:
        return 0.0
    recall = (positive[:, None] + SHIFTS[None, :] >= logit(threshold)).mean(axis=0)
    rate = found / n
    f1 = 2 * np.minimum(share * recall, rate) / (share + rate)
    if f1.max() < 2 * share / (1 + share) + CLEARLY:
        return None
    low = high = int(f1.argmax())
    while low > 0 and f1[low - 1] >= f1.max() - NEAR_BEST:
        low -= 1
    while high + 1 < len(f1) and f1[high + 1] >= f1.max() - NEAR_BEST:
        high += 1
    return float((SHIFTS[low] + SHIFTS[high]) / 2)


def flagging(known: list[np.ndarray], by_others: np.ndarray, by_model: np.ndarray, n: float, prior: float, threshold: float) -> float:
    """The shift of the model's bias, from logits of the confirmed rows of each part and from the rows flagged under each shift."""
    shift = best_shift(np.concatenate(known), by_others, n, prior, threshold) if min(map(len, known)) >= ENOUGH else None
    wanted = min(prior * n if shift is None else np.interp(shift, SHIFTS, by_others), MOST_OVER * prior * n)
    off = np.where(by_model > MOST_OVER * prior * n, np.inf, np.abs(by_model - wanted))
    return float(SHIFTS[off.argmin()]) if np.isfinite(off).any() else float(SHIFTS[0])


def added(blocks: DataFrame, run: Callable[[int, Rows], np.ndarray], columns: int, width: int) -> np.ndarray:
    """The sum over blocks (part, lengths, at) of ``run`` of a block's part and rows; tasks add up, and few tasks their sums."""

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(width), 0
        for pdf in batches:
            for part, lengths, at in zip(pdf["part"].tolist(), pdf["lengths"], pdf["at"], strict=True):
                x = Rows(np.frombuffer(at, np.uint32), np.frombuffer(lengths, np.uint32), columns)
                total, rows = total + run(part, x), rows + x.n
        if rows:
            yield pd.DataFrame({"to": [rows % ADDERS], "x": [total.astype(np.float32).tobytes()]})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_rows = np.zeros(width), False
        for pdf in batches:
            for raw in pdf["x"]:
                total, any_rows = total + np.frombuffer(raw, np.float32), True
        if any_rows:
            yield pd.DataFrame({"x": [total.tobytes()]})

    sums = blocks.select("part", "lengths", "at").mapInPandas(first, "to int, x binary").repartition(ADDERS, "to").mapInPandas(again, "x binary")
    out = np.zeros(width)
    for r in sums.collect():
        out += np.frombuffer(r["x"], np.float64)
    return out


class Learned:
    """The model, and the table of blocks (part, ids, lengths, at) that holds the columns of every row of ``docs``."""

    def __init__(self, columns: np.ndarray, weights: np.ndarray, bias: float, blocks: Cut) -> None:
        self.columns, self.weights, self.bias, self.blocks = columns, weights, bias, blocks

    def model(self) -> tuple[dict[int, float], float]:
        """(feature → weight, bias)."""
        return dict(zip(self.columns.tolist(), self.weights.tolist(), strict=True)), self.bias

    def scores(self) -> DataFrame:
        """(doc_id, score) of every row, from its columns."""
        w, b = self.weights, self.bias

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for ids, lengths, at in zip(pdf["ids"], pdf["lengths"], pdf["at"], strict=True):
                    x = Rows(np.frombuffer(at, np.uint32), np.frombuffer(lengths, np.uint32), len(w))
                    yield pd.DataFrame({"doc_id": pd.array(list(ids), "Int64"), "score": sigmoid(x.dot(w) + b)})

        return self.blocks.df.select("ids", "lengths", "at").mapInPandas(run, "doc_id bigint, score double")


def blocks_of(docs: DataFrame, columns: np.ndarray, part) -> Cut:
    """The texts of ``docs`` as blocks of their columns; ``part`` is null for rows that take no part in the fit."""
    place = {f: i for i, f in enumerate(columns.tolist())}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Known(place)
        for pdf in portions(batches):
            rows = []
            for t in pdf["text"]:
                own = set().union(*map(words.__getitem__, set(LETTERS.findall(t.lower())))) if isinstance(t, str) else ()
                rows.append(np.sort(np.fromiter(own, np.uint32, len(own))))
            parts, ids, out = pdf["part"].fillna(-1).astype(int), pdf["doc_id"].array, []
            for p in sorted(set(parts)):
                own = np.flatnonzero(parts == p).tolist()
                out.append((p, [None if pd.isna(ids[i]) else int(ids[i]) for i in own], np.array([len(rows[i]) for i in own], np.uint32).tobytes(), np.concatenate([rows[i] for i in own]).tobytes()))
            yield pd.DataFrame(out, columns=BLOCK)

    return Cut(docs.select("doc_id", "text", part.alias("part")).mapInPandas(run, BLOCKS))


def renumbered(blocks: Cut, number: np.ndarray) -> Cut:
    """``blocks`` with the columns that have a new number of 0 or more; the old table is deleted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for part, ids, lengths, at in zip(pdf["part"].tolist(), pdf["ids"], pdf["lengths"], pdf["at"], strict=True):
                x = Rows(np.frombuffer(at, np.uint32), np.frombuffer(lengths, np.uint32), len(number)).only(number)
                out.append((part, ids, np.bincount(x.of, minlength=x.n).astype(np.uint32).tobytes(), x.at.astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=BLOCK)

    new = Cut(blocks.df.mapInPandas(run, BLOCKS))
    blocks.drop()
    return new


def learn(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, most_positive: int = MOST_POSITIVE, steps: int = STEPS, seed: int = SEED) -> Learned:
    """The classifier, from labels of the training folds only; at most ``most_positive`` confirmed rows, all unlabelled ones."""
    train = one_label(labels, "toxic").where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    toxic, labelled = train.agg(F.sum("y"), F.count("*")).first()
    prior = min(max((toxic or 0) / labelled if labelled else 0.0, 1e-4), 0.9999)
    own_part = F.pmod(seeded(seed + 1), F.lit(PARTS)).cast("int")
    part = F.when(fold(F.col("doc_id"), FOLDS) != HELD_OUT, own_part)

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Known()
        for pdf in portions(batches):
            yield pd.DataFrame({"part": pdf["part"], "x": [sorted(of_text(t, words)) for t in pdf["text"]]})

    pos = cut(texts_of(docs, sample(train.where("y = 1").select("doc_id"), most_positive, seed)).select(own_part.alias("part"), "text").mapInPandas(featured, "part int, x array<bigint>"))
    n_pos = pos.count()
    common = pos.select(F.explode("x").alias("f")).groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") >= min(LEAST_POSITIVE, max(1, n_pos // 4)))
    columns = np.sort(np.array([r["f"] for r in common.orderBy(F.desc("n"), "f").limit(MOST_COLUMNS).collect()], np.int64))
    place, width = {f: i for i, f in enumerate(columns.tolist())}, len(columns)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"part": pdf["part"], "x": [np.array([place[f] for f in r.tolist() if f in place], np.uint32).tobytes() for r in pdf["x"]]})

    few = [(r["part"], np.frombuffer(r["x"], np.uint32)) for r in pos.mapInPandas(placed, "part int, x binary").collect()]
    every = blocks_of(docs, columns, part)

    def each_without(run: Callable[[Rows, int], np.ndarray], size: int) -> Callable:
        """For each classifier ``run`` on the rows that are not of its own part."""
        return lambda own, rows: np.concatenate([run(rows, k) if own != k else np.zeros(size) for k in range(PARTS + 1)])

    def positives(k: int) -> Rows:
        return Rows.of_lists([x for p, x in few if p != k], width)

    counted = added(every.df.where("part >= 0"), each_without(lambda x, _: np.concatenate([[x.n], x.back(np.ones(x.n))]), 1 + width), width, (PARTS + 1) * (1 + width)).reshape(PARTS + 1, -1)
    # columns that start with nothing in every classifier would stay so
    live = np.flatnonzero(np.any([Fit(positives(k), counted[k, 1:], counted[k, 0], prior).scale[1:] > 0 for k in range(PARTS + 1)], axis=0))
    number = np.full(width, -1, np.int64)
    number[live] = np.arange(len(live))
    every = renumbered(every, number)
    few = [(p, number[x][number[x] >= 0]) for p, x in few]
    columns, width, counted = columns[live], len(live), np.column_stack([counted[:, :1], counted[:, 1:][:, live]])
    unlabelled = every.df.where("part >= 0")
    fits = [Fit(positives(k), counted[k, 1:], counted[k, 0], prior) for k in range(PARTS + 1)]
    for _ in range(steps if any(f.able for f in fits) else 0):
        now = np.array([f.model() for f in fits])
        sums = added(unlabelled, each_without(lambda x, k, now=now: as_clean(x, now[k, 1:], now[k, 0]), 3 + width), width, (PARTS + 1) * (3 + width))
        for f, own in zip(fits, sums.reshape(PARTS + 1, -1), strict=True):
            f.step(own, steps)
    models = np.array([f.model() for f in fits])
    edge = logit(threshold)

    def over(own: int, x: Rows) -> np.ndarray:
        """Rows at or above the threshold under each shift, by the classifier that has not seen them and by the model."""
        z = (x.dot(models[k, 1:]) + models[k, 0] for k in (own, PARTS))
        return np.concatenate([[x.n], *[(v[:, None] + SHIFTS[None, :] >= edge).sum(axis=0) for v in z]])

    counts = added(unlabelled, over, width, 1 + 2 * len(SHIFTS))
    by_others, by_model = np.split(counts[1:], 2)
    known = [Rows.of_lists([x for p, x in few if p == k], width).dot(models[k, 1:]) + models[k, 0] for k in range(PARTS)]
    bias = models[PARTS, 0]
    if sum(map(len, known)) and counts[0]:
        bias += flagging(known, by_others, by_model, counts[0], prior, threshold)
    return Learned(columns, models[PARTS, 1:], float(bias), every)


def scorer(model: tuple[dict[int, float], float]):
    """A column function: whole texts → scores."""
    weights, bias = model
    known = Known({f: f for f, w in weights.items() if w})

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(sigmoid(np.array([bias + sum(weights[f] for f in sorted(of_text(t, known))) for t in texts], float)))

    return scores


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``.

    Null and empty texts score as texts without words. Rows that share an id are scored each for itself. Columns may have
    any name. An empty table gives an empty result; without labels, or without any confirmed row, all rows stay. With few confirmed rows about
    the share that is toxic among the labelled ones goes, never more than MOST_OVER times that share of the training rows.
    """
    own = unused(docs.columns, "_score")
    learned = learn(docs, labels, threshold=threshold)
    learned.blocks.drop()
    scored = docs.withColumn(own, scorer(learned.model())(named("text")))
    return scored.where(named(own) < threshold).select(*[named(c) for c in docs.columns])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts get the score of a text without words. Without labels every score is near 0; with few confirmed rows about as many
    rows are predicted as are toxic among the labelled ones. Texts of any length are read whole. Rows that share an id are scored each for itself; a null id is in no fold held out. Further columns are
    not read. An empty table gives an empty result.
    """
    s = learn(docs, labels, threshold=threshold).scores()
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return s.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
