"""Embedding near-dedup: spherical k-means cells, blocked cosine products, one representative for each group.

Cells stand in two levels: coarse centres, and in each coarse cell centres of its own. Their number grows with the vectors.

Cells lose no link. Let x have c as its nearest of some centres and let y be linked with it, so that on the unit
sphere ``|x - y|^2 = 2 - 2 cos <= 2 - 2 t``. If y's nearest is d then ``y . (d - c) >= 0``, hence
``x . (c - d) <= |x - y| |c - d|``. Among the coarse centres every x therefore also visits those cells d behind its own for
which that can hold (``d > c``: the pair's other vector needs no visit to c); in each coarse cell that it visits, and
in its own, the same holds for that cell's centres, with x's nearest of them as c (in its own, again only behind it).

Equal vectors become one with a count first. The vectors of a cell are dealt into blocks of about BLOCK. Each pair of blocks of a cell
is a task, and so is each block with its visitors from CELLS_AT_ONCE cells; a task holds one block and streams the others
past it. It hands on, for each vector, how many it is linked with, and only such links as join groups not yet
joined in that task, so a large group costs a row for each vector and not one for each pair. Products in single
precision pick what is then computed in double precision. Vectors travel in the precision in which they are stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, named

LEAST = 0.95
#: Cells of one length of vector: one for every PER_CELL vectors, at most MOST_CELLS, and in bytes of centres and of the
#: sample that they are fitted on, at most MOST_BYTES each.
PER_CELL, MOST_CELLS, MOST_BYTES, PER_CENTRE, ROUNDS, SEED = 2_048, 32_768, 64_000_000, 16, 8, 3
#: Lengths of vectors that get centres of their own; vectors of the rarer ones are one cell for each length.
MOST_LENGTHS = 64
BLOCK = 2_048
#: Visitors to a block come from so many cells at a time.
CELLS_AT_ONCE = 32


def unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def good(v) -> bool:
    """Whether a vector can link: not null, not zero, no null or non-finite component."""
    if v is None or len(v) == 0:
        return False
    a = np.asarray(v, dtype=np.float64)
    return bool(np.isfinite(a).all() and a.any())


def scaled(v, code: str) -> np.ndarray:
    """A vector that can link, by a power of two where its squares would overflow or vanish; its direction is all that counts."""
    a = np.asarray(v, dtype=np.float64)
    exponent = int(np.frexp(np.abs(a).max())[1])
    return (np.ldexp(a, -exponent) if abs(exponent) > 300 else a).astype(code)


def _read(code: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [good(v) for v in pdf["v"]]
            raw = [scaled(v, code).tobytes() if g else None for v, g in zip(pdf["v"], ok, strict=True)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"].astype("Int64"), "raw": raw, "dims": [len(v) if g else 0 for v, g in zip(pdf["v"], ok, strict=True)]})

    return run


def centres(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Spherical k-means: unit centres of unit vectors."""
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        n = np.linalg.norm(sums, axis=1)
        c = np.where(n[:, None] > 1e-9, sums / np.maximum(n, 1e-9)[:, None], c)
    return c


class Cells:
    """Coarse centres, the centres of each coarse cell, and the number of each one's first cell."""

    def __init__(self, x: np.ndarray, cells: int) -> None:
        self.coarse = centres(x, max(1, round(cells**0.5)))
        own = (x @ self.coarse.T).argmax(axis=1)
        members = np.bincount(own, minlength=len(self.coarse))
        share = np.maximum(1, np.round(cells * members / max(1, len(x)))).astype(int)
        self.fine = [centres(x[own == c], k) if n else self.coarse[c : c + 1] for c, (k, n) in enumerate(zip(share.tolist(), members.tolist(), strict=True))]
        self.first = np.concatenate([[0], np.cumsum([len(f) for f in self.fine])])

    @staticmethod
    def near(x: np.ndarray, c: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """(each vector's nearest centre, whether a vector linked with it can have each centre as its nearest)."""
        score = x @ c.T
        own = score.argmax(axis=1)
        gaps = np.sqrt(np.maximum(0, 2 - 2 * c @ c.T))
        may = score[np.arange(len(x)), own][:, None] - score <= reach * gaps[own]
        return own, may

    def place(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, list[list[int]]]:
        """(cell, cells visited) of unit vectors."""
        top, may = self.near(x, self.coarse, reach)
        may &= np.arange(len(self.coarse))[None, :] > top[:, None]
        cell, visits = np.zeros(len(x), np.int64), [[] for _ in range(len(x))]
        for c, fine in enumerate(self.fine):
            rows = np.flatnonzero((top == c) | may[:, c])
            if not len(rows):
                continue
            own, reached = self.near(x[rows], fine, reach)
            at_home = top[rows] == c
            cell[rows[at_home]] = self.first[c] + own[at_home]
            reached[at_home] &= np.arange(len(fine))[None, :] > own[at_home][:, None]
            for r, hits in zip(rows.tolist(), reached, strict=True):
                visits[r] += (self.first[c] + np.flatnonzero(hits)).tolist()
        return cell, visits


class Block:
    """One block of vectors and what others of its task are linked with."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, copies: np.ndarray, least: float) -> None:
        self.nodes, self.x, self.f, self.copies, self.least = nodes, x, x.astype(np.float32), copies, least
        self.label = np.arange(len(nodes))

    def join(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Makes the labels p[k] and q[k] one; which k did so."""
        apart = np.flatnonzero(p != q)
        if not len(apart):
            return apart
        _, one = np.unique(np.column_stack([p[apart], q[apart]]), axis=0, return_index=True)
        up: dict[int, int] = {}

        def root(i: int) -> int:
            while (to := up.get(i, i)) != i:
                up[i] = i = up.get(to, to)
            return i

        out = []
        for k in apart[one].tolist():
            a, b = root(int(p[k])), root(int(q[k]))
            if a != b:
                up[a] = b
                out.append(k)
        new = np.arange(len(self.label))
        for i in up:
            new[i] = root(i)
        self.label = new[self.label]
        return np.array(out, np.int64)

    def meet(self, nodes: np.ndarray, x: np.ndarray, copies: np.ndarray, own: bool) -> pd.DataFrame:
        """Rows (a, n, null): a has n more links; rows (a, 0, b): a is linked with b."""
        who, many, link_a, link_b = [], [], [], []
        back = np.zeros(len(self.nodes), np.int64)
        for s in range(0, len(nodes), 512):
            i, j = np.nonzero(x[s : s + 512].astype(np.float32) @ self.f.T >= self.least - 1e-4)
            i += s
            if own:
                i, j = i[i != j], j[i != j]
            for q in range(0, len(i), 200_000):
                a, b = i[q : q + 200_000], j[q : q + 200_000]
                ok = (x[a] * self.x[b]).sum(axis=1) >= self.least
                a, b = a[ok], b[ok]
                if not len(a):
                    continue
                hit, at, n = np.unique(a, return_index=True, return_inverse=True)
                who.append(nodes[hit])
                many.append(np.bincount(n, self.copies[b]).astype(np.int64))
                if own:
                    new = self.join(self.label[a], self.label[b])
                else:
                    back += np.bincount(b, copies[a], len(back)).astype(np.int64)
                    link_a.append(nodes[hit])
                    link_b.append(self.nodes[b[at]])
                    new = self.join(self.label[b[at]][n], self.label[b])
                link_a.append(nodes[a[new]])
                link_b.append(self.nodes[b[new]])
        some = np.flatnonzero(back)
        who, many = np.concatenate([*who, self.nodes[some]]), np.concatenate([*many, back[some]])
        link_a, link_b = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (link_a, link_b))
        return pd.DataFrame({"a": np.concatenate([who, link_a]), "n": np.concatenate([many, np.zeros(len(link_a), np.int64)]), "b": pd.array([None] * len(who) + link_b.tolist(), "Int64")})


def _across(code: str, least: float):
    def vectors(parts: list[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        all_rows = pd.concat(parts) if len(parts) > 1 else parts[0]
        x = np.frombuffer(b"".join(all_rows["raw"]), code).reshape(len(all_rows), -1).astype(np.float64)
        return all_rows["node"].to_numpy(), unit(x), all_rows["copies"].to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, block = None, [], None
        for pdf in batches:
            for key, part in pdf.groupby(["dims", "cell", "i", "j", "other"], sort=False):
                if key[:4] != at:
                    if held and at[2] == at[3]:
                        own = vectors(held)
                        yield Block(*own, least).meet(*own, own=True)
                    at, held, block = key[:4], [], None
                if not key[4]:
                    held.append(part)
                elif held or block is not None:
                    if block is None:
                        block, held = Block(*vectors(held), least), []
                    yield block.meet(*vectors([part]), own=False)
        if held and at[2] == at[3]:
            own = vectors(held)
            yield Block(*own, least).meet(*own, own=True)

    return run


def near_duplicates(vectors: DataFrame, column: str = "embedding", least: float = LEAST, *, per_cell: int = PER_CELL, block_size: int = BLOCK) -> DataFrame:
    """Per row of ``vectors`` (vec_id, column): vec_id, n_links, component_id, kept.

    Two vectors of the same length are linked if their cosine, in double precision, is at least ``least``.
    Vectors that are null, empty or zero, or hold a null or non-finite component, link
    with nothing. ``n_links`` are the other rows that a row's own vector is linked with. Rows with equal ids are one node of
    a component, whatever their vectors. A row without an id is linked with nothing and kept. Further columns are not
    read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = vectors.schema[column].dataType.simpleString() == "array<float>"
    code = "<f4" if single else "<f8"
    given = named(column) if single else named(column).cast("array<double>")
    rows = cut(vectors.select("vec_id", given.alias("v")).mapInPandas(_read(code), "vec_id bigint, raw binary, dims int"))
    able = rows.where("raw is not null and vec_id is not null")
    sets = cut(able.groupBy("dims", "raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    sizes = {r["dims"]: r["n"] for r in sets.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(MOST_LENGTHS).collect()}
    models: dict[int, Cells] = {}
    for dims, n in sizes.items():
        cells = max(1, min(MOST_CELLS, n // per_cell, MOST_BYTES // (8 * dims * len(sizes) * PER_CENTRE)))
        few = sets.where(F.col("dims") == dims).select("raw", "rep").orderBy(F.xxhash64("rep", F.lit(SEED)), "rep", "raw").limit(max(PER_CENTRE * cells, 1_000)).toPandas()
        models[dims] = Cells(unit(np.frombuffer(b"".join(few["raw"]), code).reshape(len(few), -1).astype(np.float64)), cells)
    shared = spark.sparkContext.broadcast(models)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6

    def cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dims, part in pdf.groupby("dims", sort=False):
                model, x = shared.value.get(dims), np.frombuffer(b"".join(part["raw"]), code).reshape(len(part), -1).astype(np.float64)
                cell, visits = model.place(unit(x), reach) if model else (0, [[] for _ in range(len(part))])
                yield part.assign(cell=cell, visits=visits)[["dims", "raw", "node", "copies", "cell", "visits"]]

    placed = cut(sets.select("dims", "raw", "node", "copies").mapInPandas(cells_of, "dims int, raw binary, node bigint, copies bigint, cell int, visits array<int>"))
    blocks = placed.groupBy("dims", "cell").agg(F.ceil(F.count("*") / block_size).cast("int").alias("blocks"))
    run = -1 - F.floor(F.col("cell") / CELLS_AT_ONCE).cast("int")
    visited = placed.select("dims", run.alias("j"), F.explode("visits").alias("cell")).distinct()
    blocks = blocks.join(visited.groupBy("dims", "cell").agg(F.collect_set("j").alias("runs")), ["dims", "cell"], "left")
    blocks = cut(blocks.withColumn("runs", F.coalesce("runs", F.array().cast("array<int>"))))
    mine = placed.drop("visits").join(blocks, ["dims", "cell"]).withColumn("own", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    # j is the other block of the cell, or below zero the visitors from one run of cells
    mine = mine.withColumn("j", F.explode(F.concat("runs", F.sequence(F.lit(0), F.col("blocks") - 1))))
    mine = mine.select("dims", "cell", F.when(F.col("j") < 0, F.col("own")).otherwise(F.least("own", "j")).alias("i"), F.when(F.col("j") < 0, F.col("j")).otherwise(F.greatest("own", "j")).alias("j"), ((F.col("j") >= 0) & (F.col("j") < F.col("own"))).alias("other"), "node", "copies", "raw")
    guest = placed.select("dims", run.alias("j"), F.explode("visits").alias("cell"), "node", "copies", "raw")
    guest = guest.join(blocks.drop("runs"), ["dims", "cell"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("dims", "cell", "i", "j", F.lit(True).alias("other"), "node", "copies", "raw")
    dealt = mine.unionByName(guest).repartition("dims", "cell", "i", "j").sortWithinPartitions("dims", "cell", "i", "j", "other")
    found = cut(dealt.select("dims", "cell", "i", "j", "other", "node", "copies", "raw").mapInPandas(_across(code, least), "a bigint, n bigint, b bigint"))
    # rows of one id are one node
    twice = able.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id")
    owned = cut(able.join(twice, "vec_id", "left_semi").distinct().join(sets.select("dims", "raw", "node"), ["dims", "raw"]).select("vec_id", "node"))
    ties = owned.join(owned.groupBy("vec_id").agg(F.min("node").alias("b")), "vec_id").where("node <> b").select(F.col("node").alias("a"), "b")
    comps = cut(connected_components(found.where("b is not null").select("a", "b").unionByName(ties)))
    low = comps.join(sets.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("low"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    by_set = sets.join(links, "node", "left").join(comps.join(low, "component").select("node", "low"), "node", "left")
    by_set = by_set.select("raw", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("low", "rep").alias("_c"))
    out = rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("raw")).alias("raw")).join(by_set, "raw", "left")
    comp = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(True)).alias("kept"))
