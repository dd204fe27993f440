"""Topics by non-negative factors and groups by k-means over term weights, with the diagnostics that decide what may be said.

The term matrix is a table of rows (record_id, at, weight) and is never gathered. A fit is a number of passes over it: tasks
solve for their rows and add up what the factors or centres need, and arrays of (topics x terms) meet on the
driver. All fits that are compared (numbers of topics, seeds, bootstraps) go along in the same passes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOP
from ..storage import hold, let_go, summed
from .textmining import spread, term_rows

SEEDS, BOOTSTRAP_SEED, DRAWN = (73, 101, 151), 173, 0.8
PASSES, TOLERANCE, INNER = 80, 1e-4, 12
TOP_TERMS, LISTED_TERMS, LISTED_DOCUMENTS = 10, 12, 10
#: Gates (fixed values).
STABLE, BOOTSTRAPPED, PREPARED, MIXED, COVERED, LEAST_TOPIC = 0.75, 0.70, 0.50, 0.65, 0.60, 3
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")
MOST_DIMENSIONS, RESTARTS, KMEANS_SEEDS, SEEDED_ON = 100, 20, (42, 73), 2_000


def character_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Runs of characters within words that have a space on either side."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def of_size(w: Column, k: int) -> Column:
        n = F.char_length(w)
        short = F.array(w) if k == low else F.array().cast("array<string>")
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(k)))).otherwise(short)

    def grams(w: Column) -> Column:
        return F.concat(*[of_size(w, k) for k in range(low, high + 1)])

    return F.flatten(F.transform(padded, grams))


def cut_grams(text: str, low: int = 3, high: int = 5) -> list[str]:
    """``character_grams`` of a text in lower case, in Python."""
    out = []
    for w in _SPACES.split(text):
        if w:
            w = f" {w} "
            for k in range(low, high + 1):
                out += [w[i : i + k] for i in range(len(w) - k + 1)] if len(w) >= k else [w] if k == low else []
    return out


@dataclass
class Matrix:
    """Unit rows of term weights: a held table (record_id, at, weight) and the terms by number."""

    rows: DataFrame
    terms: list[str]
    n: int

    @classmethod
    def of(cls, docs: DataFrame, tokens: str, *, low: int = 1, high: int = 3, most_features: int = 4000, cut: Callable[[str], list[str]] | None = None) -> Matrix:
        """TF-IDF of the documents that have any term; with at least 20 documents a term is in two or more."""
        held = spread(docs.select("record_id", F.col(tokens).alias("t")))
        n = held.where(F.col("t").rlike(r"\S") if cut else F.size("t") > 0).count()
        terms, rows = term_rows(held, "t", low=low, high=high, most_features=most_features, min_df=2 if n >= 20 else 1, cut=cut)
        # rows that share an id are one; a row alone has its terms in order already
        same = rows.groupBy("record_id").agg(F.collect_list(F.struct("at", "weight")).alias("x"))
        every = F.array_sort(F.flatten(F.transform("x", lambda r: F.arrays_zip(r["at"].alias("at"), r["weight"].alias("weight")))))
        x = F.when(F.size("x") == 1, F.get(F.col("x"), F.lit(0))).otherwise(F.struct(F.transform(every, lambda e: e["at"]).alias("at"), F.transform(every, lambda e: e["weight"]).alias("weight")))
        rows = hold(same.select("record_id", x.alias("x")).select("record_id", "x.at", "x.weight"))
        let_go(held)
        return cls(rows, terms, rows.count())

    def dense(self, pdf: pd.DataFrame) -> np.ndarray:
        return dense(pdf, len(self.terms))


def dense(pdf: pd.DataFrame, width: int) -> np.ndarray:
    x = np.zeros((len(pdf), width))
    for i, (at, w) in enumerate(zip(pdf["at"], pdf["weight"], strict=True)):
        x[i, at] = w
    return x


def singular(matrix: Matrix, k: int, seed: int = 42, passes: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as rows, singular values) of the largest k, by subspace iteration from a seeded start."""
    width = len(matrix.terms)
    wide = min(width, k + 8)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, wide)))[0]

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        x = dense(pdf, width)
        return (x.T @ (x @ q)).ravel()

    for _ in range(passes):
        z = summed(matrix.rows, gram, width * wide).reshape(width, wide)
        small = q.T @ z
        q_before, q = q, np.linalg.qr(z)[0]
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[:k]
    v = (q_before @ vectors[:, order]).T
    v *= np.where(v.sum(axis=1) < 0, -1.0, 1.0)[:, None]
    return v, np.sqrt(np.maximum(values[order], 0))


def starts(matrix: Matrix, k: int) -> tuple[np.ndarray, float]:
    """Factors from the signed parts of the singular vectors, and the mean weight that stands for their zeros."""
    v, sigma = singular(matrix, k)
    width = len(matrix.terms)

    def parts(pdf: pd.DataFrame) -> np.ndarray:
        x = dense(pdf, width)
        u = x @ v.T
        return np.concatenate([(np.maximum(u, 0) ** 2).sum(axis=0), (np.minimum(u, 0) ** 2).sum(axis=0), [x.sum()]])

    s = summed(matrix.rows, parts, 2 * k + 1)
    up, down = np.sqrt(s[:k]) / np.maximum(sigma, 1e-12), np.sqrt(s[k : 2 * k]) / np.maximum(sigma, 1e-12)
    h = np.zeros((k, width))
    for j in range(k):
        plus, minus = np.maximum(v[j], 0), np.maximum(-v[j], 0)
        a, b = up[j] * np.linalg.norm(plus), down[j] * np.linalg.norm(minus)
        part, size = (plus, a) if j == 0 or a >= b else (minus, b)
        h[j] = np.sqrt(max(sigma[j] * size, 0)) * part / max(np.linalg.norm(part), 1e-12)
    return h, float(s[-1]) / max(matrix.n * width, 1)


def solve(cross: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Non-negative weights of rows on given factors, by coordinates in turn, from the products of rows and factors and of factors."""
    w = np.maximum(cross / np.maximum(np.diag(gram), 1e-12), 0) / len(gram)
    for _ in range(INNER):
        for r in range(len(gram)):
            if gram[r, r] > 1e-12:
                w[:, r] = np.maximum(w[:, r] + (cross[:, r] - w @ gram[:, r]) / gram[r, r], 0)
    return w


def weights_of(x: np.ndarray, factors: list[np.ndarray]) -> list[np.ndarray]:
    """The weights of rows on several sets of factors; all products with the rows are one."""
    cross = np.split(x @ np.vstack(factors).T, np.cumsum([len(h) for h in factors])[:-1], axis=1)
    return [solve(c, h @ h.T) for c, h in zip(cross, factors, strict=True)]


def draws(ids: pd.Series, run: int) -> np.ndarray:
    """How often each record is drawn in a bootstrap: a Poisson number of mean DRAWN, from the id and the run alone."""
    u = np.array([(hash_of(f"{BOOTSTRAP_SEED}|{run}|{i}") + 0.5) / 2**32 for i in ids])
    edges = np.cumsum([math.exp(-DRAWN) * DRAWN**j / math.factorial(j) for j in range(12)])
    return np.searchsorted(edges, u).astype(float)


def hash_of(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=4).digest(), "little")


@dataclass
class Factors:
    """One fit in progress: its factors, which bootstrap it is (-1 for none), and how it went."""

    h: np.ndarray
    run: int = -1
    loss: float = math.inf
    passes: int = 0
    converged: bool = False

    def step(self, sums: np.ndarray) -> None:
        k, width = self.h.shape
        loss, a, b = sums[0], sums[1 : 1 + k * k].reshape(k, k), sums[1 + k * k :].reshape(k, width)
        self.passes += 1
        self.converged = self.loss - loss <= TOLERANCE * max(self.loss, 1e-12) if math.isfinite(self.loss) else False
        self.loss = loss
        if self.converged:
            return
        for _ in range(INNER):
            for r in range(k):
                if a[r, r] > 1e-12:
                    self.h[r] = np.maximum(self.h[r] + (b[r] - a[r] @ self.h) / a[r, r], 0)


def factorise(matrix: Matrix, fits: list[Factors], passes: int = PASSES) -> None:
    """Moves all fits to convergence, in the same passes over the rows."""
    width = len(matrix.terms)
    while open_ := [f for f in fits if not f.converged and f.passes < passes]:
        sizes = [1 + len(f.h) ** 2 + f.h.size for f in open_]

        def run(pdf: pd.DataFrame, open_: list[Factors] = open_) -> np.ndarray:
            x = dense(pdf, width)
            ws = weights_of(x, [f.h for f in open_])
            times = {r: np.ones(len(pdf)) if r < 0 else draws(pdf["record_id"], r) for r in {f.run for f in open_}}
            counted = [w * times[f.run][:, None] for f, w in zip(open_, ws, strict=True)]
            onto = np.split(np.hstack(counted).T @ x, np.cumsum([len(f.h) for f in open_])[:-1], axis=0)
            own = (x * x).sum(axis=1)
            out = []
            for f, w, c, b in zip(open_, ws, counted, onto, strict=True):
                # |x - wH|^2 from products that are there already
                n = times[f.run]
                a = c.T @ w
                out += [[(n * own).sum() - 2 * (b * f.h).sum() + (a * (f.h @ f.h.T)).sum()], a.ravel(), b.ravel()]
            return np.concatenate(out)

        got = summed(matrix.rows, run, sum(sizes))
        for f, own in zip(open_, np.split(got, np.cumsum(sizes)[:-1]), strict=True):
            f.step(own)


def rand_index(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    two = lambda c: (c * (c - 1) / 2).sum()
    pairs, rows, columns, every = two(table), two(table.sum(axis=1)), two(table.sum(axis=0)), two(np.array([table.sum()]))
    expected, most = rows * columns / max(every, 1), (rows + columns) / 2
    return 1.0 if most == expected else float((pairs - expected) / (most - expected))


def best_matching(score: np.ndarray) -> list[int]:
    """For each row a column of its own, with the largest sum; exact, over sets of columns."""
    k = len(score)

    @cache
    def best(row: int, left: int) -> tuple[float, tuple[int, ...]]:
        if row == k:
            return 0.0, ()
        return max((score[row, c] + (rest := best(row + 1, left & ~(1 << c)))[0], (c, *rest[1])) for c in range(k) if left >> c & 1)

    return list(best(0, (1 << k) - 1)[1])


def coherence(top: np.ndarray, counts: np.ndarray, n: int) -> float:
    """Mean normalised pointwise mutual information of the pairs of ``top`` that occur together; counts of documents by pair."""
    scores = []
    for i, a in enumerate(top):
        for b in top[i + 1 :]:
            if counts[a, b] > 0:
                p = counts[a, b] / n
                scores.append(math.log(p * n * n / (counts[a, a] * counts[b, b])) / max(-math.log(p), 1e-12))
    return float(np.mean(scores)) if scores else 0.0


def heaviest(h: np.ndarray, most: int = TOP_TERMS) -> np.ndarray:
    """The numbers of each factor's heaviest terms, ties by number."""
    return np.argsort(-h, axis=1, kind="stable")[:, :most]


def numbers_of_topics(matrix: Matrix, low: int, high: int, wanted: int | None) -> list[int]:
    distinct = matrix.rows.select("at", "weight").distinct().limit(high + 1).count()
    upper = min(high, matrix.n - 1, len(matrix.terms) - 1, distinct)
    lower = min(max(2, low), upper)
    return [wanted] if wanted and lower <= wanted <= upper else list(range(lower, upper + 1))


@dataclass
class TopicModel:
    """The chosen fit: topics, assignments and diagnostics as tables; ``gates`` what may be said of them."""

    status: str
    topics: DataFrame | None = None
    assignments: DataFrame | None = None
    diagnostics: DataFrame | None = None
    selected: dict | None = None


def topic_model(docs: DataFrame, tokens: str, text: Column, *, low: int = 4, high: int = 8, wanted: int | None = None, bootstraps: int = 5, passes: int = PASSES) -> TopicModel:
    """Non-negative factors of the term matrix of ``docs`` (record_id, tokens), with the number of topics of the best score.

    A number's score weighs coherence, agreement of seeds, of bootstraps and with character n-grams, diversity,
    balance and reconstruction. Each bootstrap draws every record a seeded Poisson number of times.
    """
    spark, matrix = docs.sparkSession, Matrix.of(docs, tokens)
    if matrix.n < 3 or len(matrix.terms) < 2:
        return TopicModel("insufficient-corpus")
    ks = numbers_of_topics(matrix, low, high, wanted)
    if not ks or ks[-1] < 2:
        return TopicModel("insufficient-distinct-documents")
    start, mean = starts(matrix, ks[-1])
    enough = bootstraps if matrix.n >= max(10, 2 * ks[0]) else 0

    def filled(k: int, seed: int | None) -> np.ndarray:
        h = start[:k].copy()
        h[h < 1e-9] = mean if seed is None else mean / 100 * np.random.default_rng(seed).random(int((h < 1e-9).sum()))
        return h

    main = {k: Factors(filled(k, None)) for k in ks}
    other = {(k, s): Factors(filled(k, s)) for k in ks for s in SEEDS}
    drawn = {(k, r): Factors(filled(k, BOOTSTRAP_SEED + r), r) for k in ks for r in range(enough)}
    factorise(matrix, [*main.values(), *other.values(), *drawn.values()], passes)
    by_letters = Matrix.of(docs.select("record_id", F.lower(text).alias("letters")), "letters", high=1, cut=cut_grams)
    letters: dict[int, Factors] = {}
    if by_letters.n and len(by_letters.terms) > ks[-1]:
        h, m = starts(by_letters, ks[-1])
        letters = {k: Factors(np.where(h[:k] < 1e-9, m, h[:k])) for k in ks}
        factorise(by_letters, list(letters.values()), passes)

    width = len(matrix.terms)
    some = np.unique(np.concatenate([heaviest(f.h).ravel() for f in main.values()]))

    def labels(models: dict, w: int, keep: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = dense(pdf, w)
                ws = dict(zip(models, weights_of(x, [f.h for f in models.values()]), strict=True))
                out = pd.DataFrame({"record_id": pdf["record_id"], "labels": list(np.column_stack([v.argmax(axis=1) for v in ws.values()]).astype(np.int32))})
                if keep:
                    out["weights"] = [np.concatenate([ws[k][i] for k in ks]) for i in range(len(pdf))]
                yield out

        return run

    first = {**main, **other}
    kind = docs.schema["record_id"].dataType.simpleString()
    told = hold(matrix.rows.mapInPandas(labels(first, width, True), f"record_id {kind}, labels array<int>, weights array<double>"))
    column = {n: i for i, n in enumerate(first)}

    def tables(pdf: pd.DataFrame) -> np.ndarray:
        x = np.stack(pdf["labels"])
        out = []
        for k in ks:
            own = x[:, column[k]]
            out += [np.bincount(own, minlength=k), *[np.bincount(own * k + x[:, column[k, s]], minlength=k * k) for s in SEEDS]]
        return np.concatenate(out).astype(float)

    agreed = np.split(summed(told.select("labels"), tables, sum(k + len(SEEDS) * k * k for k in ks)), np.cumsum([k + len(SEEDS) * k * k for k in ks])[:-1])
    together = summed(matrix.rows, lambda pdf: ((b := (dense(pdf, width)[:, some] > 0).astype(float)).T @ b).ravel(), len(some) ** 2).reshape(len(some), -1)
    counts = np.zeros((width, width)) if width <= 1 else _Sparse(some, together)
    prepared = {k: 0.0 for k in ks}
    if letters:
        again = by_letters.rows.mapInPandas(labels(letters, len(by_letters.terms), False), f"record_id {kind}, labels array<int>").withColumnRenamed("labels", "by_letters")
        both = told.join(again, "record_id").select("labels", "by_letters")

        def cross(pdf: pd.DataFrame) -> np.ndarray:
            x, y = np.stack(pdf["labels"]), np.stack(pdf["by_letters"])
            return np.concatenate([np.bincount(x[:, column[k]] * k + y[:, i], minlength=k * k) for i, k in enumerate(ks)]).astype(float)

        got = np.split(summed(both, cross, sum(k * k for k in ks)), np.cumsum([k * k for k in ks])[:-1])
        prepared = {k: rand_index(t.reshape(k, k)) for k, t in zip(ks, got, strict=True)}

    rows = []
    for k, own in zip(ks, agreed, strict=True):
        f, sizes = main[k], own[:k]
        seeds = [rand_index(t.reshape(k, k)) for t in np.split(own[k:], len(SEEDS))]
        tops = heaviest(f.h)
        unit = lambda h: h / np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-12)
        likeness = []
        for r in range(enough):
            score = unit(f.h) @ unit(drawn[k, r].h).T
            likeness.append(float(np.mean([score[i, c] for i, c in enumerate(best_matching(score))])))
        share = f.h / np.maximum(f.h.sum(axis=0, keepdims=True), 1e-12)
        least = int(min([s for s in sizes if s > 0], default=0))
        parts = {
            "coherence": float(np.mean([coherence(t, counts, matrix.n) for t in tops])), "stability": float(np.mean(seeds)), "bootstrap_stability": float(np.mean(likeness)) if likeness else 0.0,
            "preprocessing_stability": prepared[k], "topic_diversity": len(set(tops.ravel().tolist())) / (k * TOP_TERMS), "reconstruction_error": math.sqrt(max(f.loss, 0)) / math.sqrt(matrix.n),
        }
        balance = min(least / max(matrix.n / k, 1), 1.0)
        score = 0.20 * parts["coherence"] + 0.18 * parts["stability"] + 0.22 * parts["bootstrap_stability"] + 0.12 * parts["preprocessing_stability"] + 0.10 * parts["topic_diversity"] + 0.18 * balance - 0.05 * parts["reconstruction_error"]
        exclusive = float(np.mean([share[i, t].mean() for i, t in enumerate(tops)]))
        rows.append({"k": k, **parts, "bootstrap_min": min(likeness, default=0.0), "exclusivity": exclusive, "iterations": f.passes, "converged": f.converged, "min_topic_size": least, "score": score})
    rows = [{n: round(v, 6) if isinstance(v, float) else v for n, v in r.items()} for r in rows]
    best = max(rows, key=lambda r: (r["score"], r["coherence"], r["stability"]))
    best = best | {"strong_claims": best["converged"] and best["stability"] >= STABLE and best["bootstrap_stability"] >= BOOTSTRAPPED and best["preprocessing_stability"] >= PREPARED, "documents": matrix.n, "features": width}
    k = best["k"]
    at = sum(x for x in ks if x < k)
    w = F.slice("weights", at + 1, k)
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    d = told.select("record_id", F.get(F.col("labels"), F.lit(column[k])).alias("label"), w.alias("w"), F.greatest(total, F.lit(1e-12)).alias("total"))
    d = d.withColumn("p", F.transform("w", lambda x: x / F.col("total")))
    entropy = -F.aggregate("p", F.lit(0.0), lambda a, p: a + p * F.log(p + 1e-12)) / max(math.log(k), 1e-12)
    own_weight = F.get(F.col("w"), F.col("label"))
    assigned = hold(d.select("record_id", (F.col("label") + 1).cast("long").alias("topic_id"), F.round(own_weight, 6).alias("topic_weight"), F.round(own_weight / F.col("total"), 6).alias("topic_probability"), F.round(entropy, 6).alias("topic_entropy"), (entropy >= MIXED).alias("mixed_topic")))
    listed = [(i + 1, "; ".join([matrix.terms[t] for t in np.argsort(-h, kind="stable").tolist() if matrix.terms[t] not in STOP][:LISTED_TERMS])) for i, h in enumerate(main[k].h)]
    topics = spark.createDataFrame(listed, "topic_id bigint, top_terms string").join(representatives(assigned), "topic_id", "left").fillna(0, "documents")
    return TopicModel("ok", topics, assigned, spark.createDataFrame(pd.DataFrame(rows)), best)


class _Sparse:
    """Counts of documents by pairs of the terms in ``some``."""

    def __init__(self, some: np.ndarray, counts: np.ndarray) -> None:
        self.place, self.counts = {int(t): i for i, t in enumerate(some)}, counts

    def __getitem__(self, pair: tuple[int, int]) -> float:
        return float(self.counts[self.place[int(pair[0])], self.place[int(pair[1])]])


def representatives(assignments: DataFrame, most: int = LISTED_DOCUMENTS) -> DataFrame:
    """(topic_id, documents, representative_ids): the documents of the largest weight in each topic, ties by id."""
    kept = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("topic_weight")).alias("w"), F.col("record_id").alias("id")))), 1, most)
    from pyspark.sql import Window as W

    top = assignments.withColumn("place", F.row_number().over(W.partitionBy("topic_id").orderBy(F.desc("topic_weight"), "record_id")))
    sizes = assignments.groupBy("topic_id").agg(F.count("*").alias("documents"))
    listed = top.where(F.col("place") <= most).groupBy("topic_id").agg(kept.alias("x"))
    return sizes.join(listed, "topic_id").select("topic_id", "documents", F.array_join(F.transform("x", lambda x: x["id"].cast("string")), "; ").alias("representative_ids"))


def access(selected: dict | None, smallest: int, covered: float, mode: str = "auto") -> dict:
    """What a topic model may be used for: ``claim``, ``structure``, by its diagnostics, smallest topic and share of texts covered."""
    if not selected:
        return {"claim_allowed": False, "structure_allowed": False, "level": "unavailable"}
    claim = bool(selected["strong_claims"])
    structure = bool(selected["converged"] and covered >= COVERED and smallest >= LEAST_TOPIC)
    allowed = {"off": False, "strict": claim}.get(mode, structure)
    return {"claim_allowed": claim and mode != "off", "structure_allowed": allowed, "level": "claim" if claim and mode != "off" else "structure" if allowed else "unavailable"}


# groups by k-means


@dataclass
class Clusters:
    status: str
    assignments: DataFrame | None = None
    sizes: DataFrame | None = None
    diagnostics: DataFrame | None = None
    selected: dict | None = None


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: each centre is drawn by its squared distance to the ones before."""
    c = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        d = np.min([((x - y) ** 2).sum(axis=1) for y in c], axis=0)
        c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
    return np.array(c)


def moved(z: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """The sums and sizes of the groups nearest to which the points ``z`` are, then the losses, of many fits at once: ``sets`` are arrays (groups, fits, dims).

    Points meet all centres in one product and their groups' sums are another. Ties go to the first group.
    """
    flat = np.vstack([c.reshape(-1, z.shape[1]) for c in sets])
    d = z @ (-2 * flat).T
    d += (flat * flat).sum(axis=1)
    own, square = np.empty_like(d), (z * z).sum(axis=1)[:, None]
    losses, at = [], 0
    for k, fits, _ in (c.shape for c in sets):
        shape, upto = (len(z), k, fits), at + k * fits
        by = d[:, at:upto].reshape(shape)
        least = by.min(axis=1)
        same = by == least[:, None]
        if np.count_nonzero(same) > len(z) * fits:
            same = np.arange(k)[None, :, None] == by.argmin(axis=1)[:, None]
        own[:, at:upto] = same.reshape(len(z), -1)
        losses.append(np.maximum(least + square, 0).sum(axis=0))
        at = upto
    return np.concatenate([(own.T @ z).ravel(), own.sum(axis=0), *losses])


def clusters(docs: DataFrame, tokens: str, *, low: int = 2, high: int = 10, passes: int = 40, restarts: int = RESTARTS) -> Clusters:
    """k-means on the term matrix reduced to at most MOST_DIMENSIONS unit vectors, with the number of groups of the best score.

    A score weighs the silhouette (by cosine, exact, from the groups' sums), the agreement of two seeds and balance. All
    numbers, seeds and restarts move in the same passes; they start from centres drawn on SEEDED_ON seeded rows.
    """
    spark, matrix = docs.sparkSession, Matrix.of(docs, tokens)
    width = len(matrix.terms)
    dims = min(MOST_DIMENSIONS, matrix.n - 1, width - 1)
    if matrix.n < 4 or dims < 2:
        return Clusters("insufficient-corpus")
    ks = list(range(max(2, low), min(high, matrix.n - 1, matrix.rows.select("at", "weight").distinct().limit(high).count()) + 1))
    if not ks:
        return Clusters("insufficient-distinct-documents")
    v = singular(matrix, dims)[0]
    kind = docs.schema["record_id"].dataType.simpleString()

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = dense(pdf, width) @ v.T
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"record_id": pdf["record_id"], "z": list(z)})

    points = hold(matrix.rows.mapInPandas(reduce, f"record_id {kind}, z array<double>"))
    few = np.stack([np.array(r["z"]) for r in points.orderBy(F.xxhash64("record_id", F.lit(42)), "record_id").limit(SEEDED_ON).collect()])
    centres = {(k, s, i): first_centres(few, k, np.random.default_rng([s, k, i])) for k in ks for s in KMEANS_SEEDS for i in range(restarts)}
    open_, losses = list(centres), {}
    for _ in range(passes):
        # the fits of one number of groups are one array (groups, fits, dims)
        named = {k: [n for n in open_ if n[0] == k] for k in ks}
        sets = [np.stack([centres[n] for n in names], axis=1) for names in named.values() if names]
        total = sum(c.shape[0] * c.shape[1] for c in sets)

        def run(pdf: pd.DataFrame, sets: list = sets) -> np.ndarray:
            return moved(np.stack(pdf["z"]), sets)

        got = summed(points, run, total * (dims + 1) + len(open_))
        own_sums, own_sizes, own_losses = np.split(got, [total * dims, total * (dims + 1)])
        still, at, fit = [], 0, 0
        for c, names in zip(sets, filter(None, named.values()), strict=True):
            upto = at + c.shape[0] * c.shape[1]
            t, n_own = own_sums[at * dims : upto * dims].reshape(c.shape), own_sizes[at:upto].reshape(*c.shape[:2], 1)
            new = np.where(n_own > 0, t / np.maximum(n_own, 1), c)
            for j, n in enumerate(names):
                loss = own_losses[fit + j]
                if n not in losses or loss < losses[n] * (1 - 1e-6) or ((new[:, j] - centres[n]) ** 2).sum() > 1e-8:
                    still.append(n)
                losses[n], centres[n] = loss, new[:, j]
            at, fit = upto, fit + len(names)
        if not (open_ := still):
            break
    best = {(k, s): centres[min(((k, s, i) for i in range(restarts)), key=lambda n: (losses[n], n))] for k in ks for s in KMEANS_SEEDS}
    names = list(best)

    def nearest(z: np.ndarray) -> np.ndarray:
        return np.column_stack([((c * c).sum(axis=1)[None, :] - 2 * z @ c.T).argmin(axis=1) for c in best.values()])

    def totals(pdf: pd.DataFrame) -> np.ndarray:
        z = np.stack(pdf["z"])
        own, out = nearest(z), []
        for k in ks:
            a, b = own[:, names.index((k, KMEANS_SEEDS[0]))], own[:, names.index((k, KMEANS_SEEDS[1]))]
            out += [(np.eye(k)[a].T @ z).ravel(), np.bincount(a, minlength=k), np.bincount(a * k + b, minlength=k * k)]
        return np.concatenate(out).astype(float)

    shapes = [k * dims + k + k * k for k in ks]
    got = dict(zip(ks, np.split(summed(points, totals, sum(shapes)), np.cumsum(shapes)[:-1]), strict=True))
    sums = {k: (t[: k * dims].reshape(k, dims), t[k * dims : k * dims + k]) for k, t in got.items()}

    def silhouettes(pdf: pd.DataFrame) -> np.ndarray:
        z = np.stack(pdf["z"])
        own = nearest(z)
        return np.array([silhouette(z, own[:, names.index((k, KMEANS_SEEDS[0]))], *sums[k]).sum() for k in ks])

    wide = summed(points, silhouettes, len(ks)) / matrix.n
    rows = []
    for i, k in enumerate(ks):
        n = sums[k][1]
        least, agree = int(n[n > 0].min()), rand_index(got[k][k * dims + k :].reshape(k, k))
        value = float(wide[i]) if (n > 0).sum() > 1 else -1.0
        rows.append({"k": k, "silhouette": round(value, 6), "stability": round(agree, 6), "min_cluster_size": least, "score": round(0.55 * value + 0.30 * agree + 0.15 * min(least / max(matrix.n / k, 1), 1.0), 6)})
    chosen = max(rows, key=lambda r: (r["score"], r["silhouette"], r["stability"]))
    c = best[chosen["k"], KMEANS_SEEDS[0]]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = np.stack(pdf["z"])
            own = ((c * c).sum(axis=1)[None, :] - 2 * z @ c.T).argmin(axis=1)
            yield pd.DataFrame({"record_id": pdf["record_id"], "cluster_id": own + 1, "distance": np.round(np.linalg.norm(z - c[own], axis=1), 6)})

    assigned = hold(points.mapInPandas(assign, f"record_id {kind}, cluster_id bigint, distance double"))
    return Clusters("ok", assigned, assigned.groupBy("cluster_id").agg(F.count("*").alias("documents")), spark.createDataFrame(pd.DataFrame(rows)), chosen)


def silhouette(z: np.ndarray, own: np.ndarray, sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Silhouettes by cosine distance of unit vectors: the mean distance to a group is one less the product with its mean."""
    near = z @ sums.T
    at = np.arange(len(z))
    inside = (n[own] - near[at, own]) / np.maximum(n[own] - 1, 1)
    far = np.where(n[None, :] > 0, 1 - near / np.maximum(n[None, :], 1), np.inf)
    far[at, own] = np.inf
    outside = far.min(axis=1)
    value = (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300)
    return np.where((n[own] > 1) & np.isfinite(outside), value, 0.0)


def incremental(selected: dict | None, agreement: float) -> dict:
    """Whether groups tell something that topics do not: silhouette, stability, least size, and little shared information."""
    if not selected:
        return {"status": "unavailable", "writing_allowed": False}
    good = selected["silhouette"] >= 0.15 and selected["stability"] >= 0.75 and selected["min_cluster_size"] >= 3
    ready = bool(good and agreement < 0.85)
    return {"status": "ready" if ready else "no-incremental-structure" if good else "exploratory", "writing_allowed": ready}


def embedding_size(records: DataFrame, text: Column, per_chunk: int = 2_400) -> DataFrame:
    """One row: documents, characters and the chunks that embedding them would take; nothing is embedded."""
    s = records.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.char_length(text)), F.lit(0)).cast("long").alias("characters"))
    return s.select("documents", "characters", F.greatest(F.col("documents"), F.ceil(F.col("characters") / per_chunk)).cast("long").alias("estimated_chunks"))
