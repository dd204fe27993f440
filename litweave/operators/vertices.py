"""Measures of the nodes of many networks at once, as tables of vertices and arcs.

Edges are (network, a, b, weight), undirected: the two orders of an edge are one, its weights add up, loops and weights
that are not above zero are left out. Weights are taken in millionths, so that sums do not depend on the order of rows and
equal ways are equal. An arc of a node with more than ``PART`` arcs belongs to one of several parts of the node, so that
no join has a hub in one task. Each round of an iteration is a step from table to table; only counts and one row for each
network reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import hold, in_rounds, let_go, read_in
from .networks import constraint

#: Arcs of a node that are joined in one piece; weight of one unit.
PART, UNITS = 10_000, 1_000_000
#: Rows of one key that are joined by shuffle, and most keys that are joined by broadcast instead.
FEW, HOT = 10_000, 1_000
#: Where a node counts as connector, broker or core (fixed values).
CONNECTS, CONSTRAINED, BROAD, CORE_RANK = 0.55, 0.45, 2.0, 0.75
KEY = ["network", "node"]


def undirected(edges: DataFrame) -> DataFrame:
    """(network, a, b, w): each edge once, a < b, w in units."""
    e = edges.select(F.col("network").cast("string").alias("network"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.round(F.col("weight").cast("double") * UNITS).cast("long").alias("w"))
    return e.where("a <> b and w > 0").groupBy("network", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("w").alias("w"))


class Graph:
    """``arcs`` (network, node, part, other, w) and ``nodes`` (network, node, degree, strength, parts) of edges (network, a, b, w).

    ``directed``: arcs lead from a to b only. Nodes without an arc of their own have degree 0.
    """

    def __init__(self, edges: DataFrame, directed: bool = False, isolated: DataFrame | None = None) -> None:
        one = edges.select("network", F.col("a").alias("node"), F.col("b").alias("other"), "w")
        back = edges.select("network", F.col("b").alias("node"), F.col("a").alias("other"), "w")
        arcs = one if directed else one.unionByName(back)
        ends = one.select(*KEY).unionByName(back.select(*KEY))
        if isolated is not None:
            ends = ends.unionByName(isolated.select(*KEY))
        own = arcs.groupBy(*KEY).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))
        zero = F.lit(0).cast("long")
        v = ends.distinct().join(own, KEY, "left").select(*KEY, F.coalesce("degree", zero).alias("degree"), F.coalesce("strength", zero).alias("strength"))
        self.nodes = hold(v.withColumn("parts", (1 + F.floor(F.col("degree") / PART)).cast("int")))
        many = self.nodes.where("parts > 1").select(*KEY, "parts")
        # fewer than arcs / PART nodes have several parts
        part = F.coalesce(F.pmod(F.xxhash64("other"), F.col("parts")).cast("int"), F.lit(0))
        self.arcs = hold(arcs.join(many, KEY, "left").select(*KEY, part.alias("part"), "other", "w"))

    def sent(self, state: DataFrame, *what: Column) -> DataFrame:
        """A row (network, node, ``what``) at the end of each arc from a node of ``state``, which has the node's parts."""
        spread = state.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return self.arcs.join(spread, [*KEY, "part"]).select("network", F.col("other").alias("node"), *what)


def sized(left: DataFrame, right: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``left`` with the one row of ``right`` that each of its rows has; ``size`` tells how many rows of ``left`` a row of ``right`` has.

    Rows of ``right`` with more than FEW and more than 1 / HOT of the ``total`` rows, which are fewer than HOT, are broadcast.
    """
    if total <= FEW:
        return left.join(right.drop(size), keys)
    hot = F.col(size) > max(FEW, total // HOT)
    new = [c for c in right.columns if c not in (*keys, size)]
    some = left.join(F.broadcast(right.where(hot).withColumn("_hot", F.lit(True)).drop(size)), keys, "left")
    rest = some.where("_hot is null").drop("_hot", *new).join(right.where(~hot).drop(size), keys)
    return some.where("_hot").drop("_hot").unionByName(rest)


def pagerank(graph: Graph, damping: float = 0.85, tolerance: float = 1e-9, most: int = 400, at_once: int = 6) -> DataFrame:
    """(network, node, pagerank): shares of a walk along arcs by weight that starts anew with probability 1 - ``damping``.

    A node without arcs starts anew everywhere. Rounds end when no network's ranks move by ``tolerance`` in all; ``at_once`` of them
    are one job.
    """
    n = graph.nodes.groupBy("network").agg(F.count("*").alias("n"), F.max((F.col("degree") == 0).cast("int")).alias("loose"))
    loose = bool(n.agg(F.max("loose")).first()[0])
    rank = hold(graph.nodes.join(n.drop("loose"), "network").select(*KEY, "parts", "strength", "n", (1.0 / F.col("n")).alias("rank"), F.lit(0.0).alias("before")))
    for _ in range(0, most, at_once):
        now = rank
        for _ in range(at_once):
            got = graph.sent(now.where("strength > 0"), (F.col("rank") * F.col("w") / F.col("strength")).alias("x")).groupBy(*KEY).agg(F.sum("x").alias("x"))
            step = now.join(got, KEY, "left")
            lost = F.lit(0.0)
            if loose:
                step = step.join(now.where("strength = 0").groupBy("network").agg(F.sum("rank").alias("lost")), "network", "left")
                lost = F.coalesce("lost", F.lit(0.0)) / F.col("n")
            new = (1 - damping) / F.col("n") + damping * (F.coalesce("x", F.lit(0.0)) + lost)
            now = step.select(*KEY, "parts", "strength", "n", new.alias("rank"), F.col("rank").alias("before"))
        now = hold(now)
        moved = now.groupBy("network").agg(F.sum(F.abs(F.col("rank") - F.col("before"))).alias("m")).agg(F.max("m")).first()[0] or 0.0
        let_go(rank)
        rank = now
        if moved < tolerance:
            break
    return rank.select(*KEY, F.col("rank").alias("pagerank"))


def core_numbers(graph: Graph) -> DataFrame:
    """(network, node, k_core): each node lowers its bound, its degree at first, to the h-index of its neighbours' bounds until none changes."""
    bound = hold(graph.nodes.select(*KEY, "parts", F.col("degree").alias("k")))
    while True:
        seen = graph.sent(bound, "k").groupBy(*KEY, F.col("k").alias("v")).agg(F.count("*").alias("n"))
        above = F.sum("n").over(W.partitionBy(*KEY).orderBy(F.desc("v")))
        h = seen.select(*KEY, F.least("v", above).alias("h")).groupBy(*KEY).agg(F.max("h").alias("h"))
        new = hold(bound.join(h, KEY, "left").select(*KEY, "parts", F.least("k", F.coalesce("h", F.lit(0).cast("long"))).alias("k"), F.col("k").alias("before")))
        changed = not new.where("k < before").isEmpty()
        let_go(bound)
        bound = new
        if not changed:
            return bound.select(*KEY, F.col("k").alias("k_core"))


def triangles(edges: DataFrame, block: int = 2_000) -> DataFrame:
    """(network, a, b, c, x): every triangle of edges (network, a, b, w) once, x being the product of its weights in units of 1."""
    return closed(edges.withColumn("w", F.col("w") / UNITS), block).select("network", "a", "b", "c", (F.col("ab") * F.col("ac") * F.col("bc")).alias("x"))


def closed(edges: DataFrame, block: int = 2_000) -> DataFrame:
    """(network, a, b, c, ab, ac, bc): every triangle of edges (network, a, b, w) once, with the weights of its sides.

    Edges point to the end of more edges (equal ones by name), so no node has more than about the root of twice the edges ahead. The arcs of a node
    are dealt into blocks, and each pair of blocks is a key of its own, so that a node's wedges are the work of many tasks.
    """
    deg = edges.select("network", F.explode(F.array("a", "b")).alias("node")).groupBy("network", "node").agg(F.count("*").alias("d"))
    total = edges.count() * 2
    ends = edges.select("network", "a", "b", "w")
    ends = sized(ends.withColumnRenamed("a", "node"), deg.withColumn("n", F.col("d")), KEY, "n", total).withColumnsRenamed({"node": "a", "d": "da"})
    ends = sized(ends.withColumnRenamed("b", "node"), deg.withColumn("n", F.col("d")), KEY, "n", total).withColumnsRenamed({"node": "b", "d": "db"})
    up = F.struct("da", "a") < F.struct("db", "b")
    arcs = hold(ends.select("network", F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("high"), "w"))
    blocks = arcs.groupBy("network", "low").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = arcs.join(blocks, ["network", "low"]).withColumn("own", F.pmod(F.xxhash64("high"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("network", "low", "high", "w", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"))
    x = dealt.where("own = i").select("network", "low", "i", "j", F.col("high").alias("p"), F.col("w").alias("wp"))
    y = dealt.where("own = j").select("network", "low", "i", "j", F.col("high").alias("q"), F.col("w").alias("wq"))
    wedges = x.join(y, ["network", "low", "i", "j"]).where("(i = j and p < q) or (i < j)")
    turned = F.col("p") > F.col("q")
    wedges = wedges.select("network", "low", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(turned, F.col("wq")).otherwise(F.col("wp")).alias("wp"), F.when(turned, F.col("wp")).otherwise(F.col("wq")).alias("wq"))
    closing = arcs.select("network", F.least("low", "high").alias("p"), F.greatest("low", "high").alias("q"), "w")
    return wedges.join(closing, ["network", "p", "q"]).select("network", F.col("low").alias("a"), F.col("p").alias("b"), F.col("q").alias("c"), F.col("wp").alias("ab"), F.col("wq").alias("ac"), F.col("w").alias("bc"))


def clustering(edges: DataFrame, graph: Graph, weighted: bool = False) -> DataFrame:
    """(network, node, triangles, clustering): the share of a node's pairs of neighbours that are linked; weighted, by the cube root of the three weights as shares of the largest."""
    t = triangles(edges)
    own = t.select("network", F.explode(F.array("a", "b", "c")).alias("node"), F.cbrt("x").alias("x")).groupBy(*KEY).agg(F.count("*").alias("t"), F.sum("x").alias("x"))
    top = edges.groupBy("network").agg((F.max("w") / UNITS).alias("top"))
    v = graph.nodes.join(own, KEY, "left").join(top, "network", "left")
    amount = F.col("x") / F.col("top") if weighted else F.col("t").cast("double")
    c = F.when(F.col("degree") > 1, 2 * F.coalesce(amount, F.lit(0.0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return v.select(*KEY, F.coalesce("t", F.lit(0).cast("long")).alias("triangles"), c.alias("clustering"))


# communities

_EXACT = "decimal(38,0)"
#: Rounds in which a network's moves are made at once.
MOST_AT_ONCE = 40


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(19,0)")


class Moves:
    """Nodes (network, node, parts, k, m2) in communities c, before in ``was``, and for each the best move there is.

    ``table`` is ``state`` with these moves, held; ``moves`` has (network, node, c, d, gain) of every node that modularity grows by moving, ``quality`` the modularity of each network times
    the square of twice its weight, exactly.
    """

    def __init__(self, graph: Graph, state: DataFrame, size: int) -> None:
        tot = state.groupBy("network", "c").agg(F.sum("k").alias("tot"), F.count("*").alias("size"))
        placed = sized(state, tot, ["network", "c"], "size", size)
        links = graph.sent(placed, "c", "tot", "w").groupBy(*KEY, F.col("c").alias("d")).agg(F.sum("w").alias("link"), F.max("tot").alias("to"))
        own = placed.join(links, KEY, "left")
        inside = F.col("d") == F.col("c")
        value = _exact("link") * _exact("m2") - _exact("k") * F.when(inside, _exact("to") - _exact("k")).otherwise(_exact("to"))
        alone = -_exact("k") * (_exact("tot") - _exact("k"))  # a node without a link into its own community
        kept = [*KEY, "parts", "k", "m2", "c", "was"]
        each = own.select(*kept, alone.cast(_EXACT).alias("alone"), "d", inside.alias("inside"), F.when(inside, F.col("link")).otherwise(0).alias("in_link"), "tot", value.cast(_EXACT).alias("value"))
        best = each.groupBy(*kept).agg(
            F.min(F.when(~F.col("inside"), F.struct((-F.col("value")).alias("less"), "d"))).alias("best"),
            F.coalesce(F.max(F.when(F.col("inside"), F.col("value"))), F.max("alone")).alias("stay"), (F.max(_exact("in_link")) * F.max(_exact("m2")) - F.max(_exact("k")) * F.max(_exact("tot"))).cast(_EXACT).alias("share"),
        )
        gain = (-F.col("best.less") - F.col("stay")).cast(_EXACT)
        self.table = hold(best.select(*kept, F.col("best.d").alias("d"), gain.alias("gain"), "share"))
        self.moves = self.table.where("gain > 0")
        # a community's total squared is the sum over its nodes of their strength times the total
        rows = self.table.groupBy("network").agg(F.sum("share").alias("q"), F.sum((F.col("gain") > 0).cast("long")).alias("n")).collect()
        self.quality = {r["network"]: int(r["q"]) for r in rows}
        self.open = {r["network"] for r in rows if r["n"]}

    def chosen(self, networks: list[str], turn: int, alone: bool) -> DataFrame:
        """Moves (network, node, d) to make: about half of all, by a hash; ``alone``: such that no community has two, whose gains add up."""
        m = self.moves.where(F.col("network").isin(networks)).select(*KEY, "c", "d", "gain")
        if not alone:
            return m.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0).select(*KEY, "d")
        key = F.struct("gain", F.xxhash64("node", F.lit(turn)).alias("h"), "node", "d")
        first = m.select("network", F.explode(F.array("c", "d")).alias("community"), key.alias("move")).groupBy("network", "community").agg(F.max("move").alias("move"))
        return first.select("network", "move.node", "move.d").groupBy(*KEY, "d").agg(F.count("*").alias("n")).where("n = 2").select(*KEY, "d")


def settle(graph: Graph, state: DataFrame) -> tuple[DataFrame, bool]:
    """``state`` after moves of single nodes until none is left that modularity grows by, and whether any was made.

    Half of the moves are made at once, by a hash; if a network's modularity did not grow by that, it goes back and makes moves of different communities only,
    by which it must grow.
    """
    state = hold(state.withColumn("was", F.col("c")))
    size, turn, before, had = state.count(), 0, None, {}
    step = hold if size > FEW else lambda few: few  # few nodes are read off the moves before them sooner than they are held
    while True:
        now = Moves(graph, state, size)
        worse = sorted(n for n, q in now.quality.items() if before is not None and n in before.open and q <= had[n])
        if not worse and not now.open:
            return now.table.select(*KEY, "parts", "k", "m2", "c"), before is not None
        turn += 1
        fine = sorted(now.quality.keys() - set(worse))
        moves = now.chosen(fine, turn, alone=turn > MOST_AT_ONCE)
        if worse:
            moves = moves.unionByName(before.chosen(worse, turn, alone=True))
        had |= {n: now.quality[n] for n in fine}
        base = F.when(F.col("network").isin(worse), F.col("was")).otherwise(F.col("c"))
        state = now.table.select(*KEY, "parts", "k", "m2", base.alias("was")).join(moves, KEY, "left")
        state = step(state.select(*KEY, "parts", "k", "m2", F.coalesce("d", "was").alias("c"), "was"))
        before = now


def communities(edges: DataFrame, graph: Graph) -> DataFrame:
    """(network, node, community), the community named by its smallest node, of edges (network, a, b, w).

    Nodes move one by one as in ``settle``, communities become the nodes of a smaller graph in which they move likewise, and then single nodes
    again, until neither moves. No move of a single node makes modularity grow. The result does not depend on partitions.
    """
    m2 = graph.nodes.groupBy("network").agg(F.sum("strength").alias("m2"))
    state = graph.nodes.join(m2, "network").select(*KEY, "parts", F.col("strength").alias("k"), "m2", F.col("node").alias("c"))
    while True:
        state, _ = settle(graph, state)
        place = state.select("network", "node", "c")
        e = edges.join(place.withColumnsRenamed({"node": "a", "c": "ca"}), ["network", "a"]).join(place.withColumnsRenamed({"node": "b", "c": "cb"}), ["network", "b"])
        e = hold(e.where("ca <> cb").groupBy("network", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum("w").alias("w")))
        tops = state.groupBy("network", F.col("c").alias("node")).agg(F.sum("k").alias("k"), F.max("m2").alias("m2"))
        folded = Graph(e, isolated=tops)
        larger, any_moved = settle(folded, tops.join(folded.nodes.select(*KEY, "parts"), KEY).select(*KEY, "parts", "k", "m2", F.col("node").alias("c")))
        if not any_moved:
            names = state.groupBy("network", "c").agg(F.min("node").alias("community"))
            return state.join(names, ["network", "c"]).select(*KEY, "community")
        up = larger.select("network", F.col("node").alias("c"), F.col("c").alias("d"))
        state = state.join(up, ["network", "c"]).select(*KEY, "parts", "k", "m2", F.col("d").alias("c"))


def modularity(edges: DataFrame, graph: Graph, place: DataFrame) -> DataFrame:
    """(network, modularity) of a partition (network, node, community)."""
    e = edges.join(place.withColumnsRenamed({"node": "a", "community": "ca"}), ["network", "a"]).join(place.withColumnsRenamed({"node": "b", "community": "cb"}), ["network", "b"])
    inner = e.groupBy("network").agg(F.sum(F.when(F.col("ca") == F.col("cb"), 2 * F.col("w")).otherwise(0)).alias("inner"), (2 * F.sum("w")).alias("m2"))
    tot = graph.nodes.join(place, KEY).groupBy("network", "community").agg(F.sum("strength").alias("t"))
    return tot.join(inner, "network").groupBy("network").agg((F.max(F.col("inner") / F.col("m2")) - F.sum(F.pow(F.col("t") / F.col("m2"), 2))).alias("modularity"))


# shortest ways


def _added(parts: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.sum(value).alias(value))


def distances(graph: Graph, sources: DataFrame, unit: bool = False) -> DataFrame:
    """(network, s, node, d): the length of the shortest way from each of ``sources`` (network, node) to every node it reaches.

    Each round only ways that became shorter are carried on. ``unit``: every arc has length 1.
    """
    known = hold(sources.select("network", F.col("node").alias("s"), "node", F.lit(0).cast("long").alias("d"), F.lit(True).alias("new")))
    length = F.lit(1).cast("long") if unit else F.col("w")
    parts = graph.nodes.select(*KEY, "parts")
    while True:
        front = known.where("new").join(parts, KEY)
        longer = graph.sent(front, "s", (F.col("d") + length).alias("d"))
        ways = known.select("network", "s", "node", "d", F.lit(True).alias("old")).unionByName(longer.withColumn("old", F.lit(False)))
        best = ways.groupBy("network", "s", "node").agg(F.min("d").alias("d"), F.min(F.when(F.col("old"), F.col("d"))).alias("had"))
        step = hold(best.select("network", "s", "node", "d", (F.col("had").isNull() | (F.col("d") < F.col("had"))).alias("new")))
        done = step.where("new").isEmpty()
        let_go(known)
        known = step
        if done:
            return known


def dependencies(graph: Graph, sources: DataFrame, unit: bool = False) -> DataFrame:
    """(network, node, share): for each node the shares of the shortest ways from ``sources`` to other nodes that lead through it, added up.

    The arcs of shortest ways have no cycle, so the ways to a node are added up by their number of arcs, from the source on, and what
    depends on a node likewise from the far ends back: with u(v) the sum over all that is behind v of the ways from v there as a share of the ways from the source.
    """
    d = distances(graph, sources, unit)
    key = ["network", "s", "node"]
    length = F.lit(1).cast("long") if unit else F.col("w")
    there = graph.sent(d.join(graph.nodes.select(*KEY, "parts"), KEY), "s", F.col("node").alias("above"), (F.col("d") + length).alias("d"))
    ways = hold(there.join(d, [*key, "d"]).select("network", "s", "above", "node"))
    level = hold(d.where("s = node").select(*key, F.lit(1.0).alias("x")))
    levels = [level]
    while True:
        step = level.withColumnRenamed("node", "above").join(ways, ["network", "s", "above"]).groupBy(*key).agg(F.sum("x").alias("x"))
        level = hold(step)
        if level.isEmpty():
            break
        levels.append(level)
    paths = hold(_added(levels, key, "x").withColumnRenamed("x", "paths"))
    level = paths.select(*key, (1 / F.col("paths")).alias("x"))
    behind = []
    for _ in levels[1:]:
        level = hold(ways.join(level, key).groupBy("network", "s", F.col("above").alias("node")).agg(F.sum("x").alias("x")))
        behind.append(level)
    if not behind:
        return d.where("false").select(*KEY, F.lit(0.0).alias("share"))
    share = _added(behind, key, "x").join(paths, key).where("s <> node").groupBy(*KEY).agg(F.sum(F.col("x") * F.col("paths")).alias("share"))
    out = hold(share)
    let_go(d, ways, paths, *levels, *behind)
    return out


def hops(graph: Graph, back: Graph, sources: DataFrame) -> DataFrame:
    """(network, node, share) as of ``dependencies`` where every arc has length 1; ``back`` is the graph with its arcs turned round. Held.

    A level has the nodes that many arcs from a source, with the number of shortest ways there, and is written once. Back from the far end, what is behind
    a node v adds up in g(v), 1 / ways(v) and the g of the nodes one level on; v's share is ways(v) times these.
    """
    key = ["network", "s", "node"]
    several = {g: not g.nodes.where("parts > 1").isEmpty() for g in (graph, back)}
    parted = lambda g, state: state.join(g.nodes.select(*KEY, "parts"), KEY) if several[g] else state.withColumn("parts", F.lit(1))
    level = hold(sources.select("network", F.col("node").alias("s"), "node", F.lit(1.0).alias("x")))
    levels = []
    while not level.isEmpty():
        levels.append(level)
        seen = reduce(DataFrame.unionByName, [x.select(*key) for x in levels])
        on = graph.sent(parted(graph, level), "s", "x").groupBy(*key).agg(F.sum("x").alias("x"))
        level = hold(on.join(seen, key, "left_anti"))
    let_go(level)
    shares = [sources.where("false").select(*KEY, F.lit(0.0).alias("share"))]
    held, g = [], levels[-1].select(*key, (1 / F.col("x")).alias("g")) if levels else None
    for level in levels[-2:0:-1]:
        behind = back.sent(parted(back, g), "s", "g").groupBy(*key).agg(F.sum("g").alias("behind"))
        held.append(hold(level.join(behind, key, "left").select(*key, "x", F.coalesce("behind", F.lit(0.0)).alias("behind"))))
        shares.append(held[-1].select(*KEY, (F.col("x") * F.col("behind")).alias("share")))
        g = held[-1].select(*key, (1 / F.col("x") + F.col("behind")).alias("g"))
    out = hold(_added(shares, KEY, "share"))
    let_go(*levels, *held)
    return out


def in_batches(nodes: DataFrame, batch: int) -> list[DataFrame]:
    """``nodes`` in parts of about ``batch``, by a hash of the node."""
    n = max(1, -(-nodes.count() // batch))
    return [nodes.where(F.pmod(F.xxhash64(*KEY), F.lit(n)) == k) for k in range(n)]


def betweenness(graph: Graph, batch: int = 512, unit: bool = False) -> DataFrame:
    """(network, node, betweenness): shares of all shortest ways that lead through a node, of (n - 1)(n - 2).

    ``batch`` sources are on their way at once, so there are at most ``batch`` rows for each node at a time, and for each arc of a shortest way.
    """
    shares = [dependencies(graph, b, unit) for b in in_batches(graph.nodes.select(*KEY), batch)]
    return of_pairs(graph, _added(shares, KEY, "share"))


def of_pairs(graph: Graph, total: DataFrame) -> DataFrame:
    """(network, node, betweenness): shares (network, node, share) of all ways as parts of (n - 1)(n - 2), 0 for nodes that have none."""
    n = graph.nodes.groupBy("network").agg(F.count("*").alias("n"))
    scale = F.when(F.col("n") > 2, (F.col("n") - 1) * (F.col("n") - 2)).otherwise(1)
    return graph.nodes.join(n, "network").join(total, KEY, "left").select(*KEY, (F.coalesce("share", F.lit(0.0)) / scale).alias("betweenness"))


def closeness(graph: Graph, batch: int = 512) -> DataFrame:
    """(network, node, closeness): by numbers of arcs, scaled by the part of the network that a node reaches."""
    n = graph.nodes.groupBy("network").agg(F.count("*").alias("n"))
    found = []
    for b in in_batches(graph.nodes.select(*KEY), batch):
        d = distances(graph, b, unit=True)
        found.append(hold(d.groupBy("network", F.col("s").alias("node")).agg((F.count("*") - 1).alias("reached"), F.sum("d").alias("all"))))
        let_go(d)
    value = F.when(F.col("all") > 0, F.col("reached") / F.col("all") * F.col("reached") / (F.col("n") - 1)).otherwise(0.0)
    return reduce(DataFrame.unionByName, found).join(n, "network").select(*KEY, value.alias("closeness"))


# all together


def _own(edges: DataFrame) -> DataFrame:
    """The edges (network, a, b, w), held, in a session for rounds of their size."""
    e = hold(undirected(edges))
    return in_rounds(e, e.count())


def _here(out: DataFrame, edges: DataFrame) -> DataFrame:
    """``out``, held, in the session of ``edges``."""
    return read_in(edges.sparkSession, hold(out))


def places(edges: DataFrame) -> DataFrame:
    """(network, node, community) of the networks (network, a, b, weight), as ``communities`` has them, held."""
    e = _own(edges)
    return _here(communities(e, Graph(e)), edges)


def measures(edges: DataFrame, place: DataFrame | None = None) -> DataFrame:
    """Every measure of each node of the networks (network, a, b, weight), and its place and role in it, held.

    Participation is over the communities of a node's neighbours, the z-score that of its strength among the members of its
    community. Of equal values none depends on the order of rows. ``place``, a held table, has the communities where they are known.
    """
    e = _own(edges)
    g = Graph(e)
    place = hold(communities(e, g)) if place is None else read_in(e.sparkSession, place)
    weight = (F.col("w") / UNITS).alias("weight")
    tag = lambda c: F.concat_ws("\x01", "network", c)
    holes = constraint(e.select(tag("a").alias("a"), tag("b").alias("b"), weight))
    holes = holes.select(F.split("node", "\x01")[0].alias("network"), F.split("node", "\x01")[1].alias("node"), "constraint", "effective_size")
    to = g.sent(place.join(g.nodes.select(*KEY, "parts"), KEY), "community", "w").groupBy(*KEY, "community").agg(F.sum("w").alias("w"))
    part = to.groupBy(*KEY).agg((1 - F.sum(F.pow(F.col("w").cast("double"), 2)) / F.pow(F.sum("w").cast("double"), 2)).alias("participation"))
    v = g.nodes.join(place, KEY).withColumn("weighted_degree", F.col("strength") / UNITS)
    peers = v.groupBy("network", "community").agg(F.avg("weighted_degree").alias("mean"), F.stddev_pop("weighted_degree").alias("sd"))
    z = F.when(F.col("sd") > 1e-12, (F.col("weighted_degree") - F.col("mean")) / F.col("sd")).otherwise(0.0)
    v = v.join(peers, ["network", "community"]).withColumn("within_module_z", z)
    for more in (pagerank(g), betweenness(g), closeness(g), core_numbers(g), holes, part):
        v = v.join(more, KEY)
    v = hold(v)
    most = v.groupBy("network").agg(F.max("k_core").alias("most"), F.percentile("pagerank", CORE_RANK).alias("high"))
    core = (F.col("k_core") >= F.col("most")) | (F.col("pagerank") >= F.col("high"))
    role = F.when((F.col("participation") >= CONNECTS) & (F.col("betweenness") > 0), "connector").when((F.col("constraint") <= CONSTRAINED) & (F.col("effective_size") >= BROAD), "broker").when(core, "hub").otherwise("peripheral")
    out = v.join(most, "network").select(
        *KEY, "community", "degree", F.round("weighted_degree", 6).alias("weighted_degree"), *[F.round(c, 8).alias(c) for c in ("pagerank", "betweenness", "closeness")], "k_core",
        F.round("constraint", 8).alias("constraint"), F.round("effective_size", 8).alias("effective_size"), F.round(F.col("effective_size") / F.col("degree"), 8).alias("efficiency"),
        F.round("participation", 8).alias("participation"), F.round("within_module_z", 8).alias("within_module_z"), F.when(core, "core").otherwise("periphery").alias("core_periphery"), role.alias("brokerage_role"),
    )
    return _here(out, edges)


def summaries(edges: DataFrame, place: DataFrame | None = None) -> DataFrame:
    """One row for each network of (network, a, b, weight): nodes, edges, density, components, average weighted clustering, modularity.

    ``place`` (network, node, community), a held table, has the communities where they are known.
    """
    from .graphs import components

    e = _own(edges)
    g = Graph(e)
    place = place and read_in(e.sparkSession, place)
    tag = lambda c: F.concat_ws("\x01", "network", c)
    parts = components(e.select(tag("a").alias("a"), tag("b").alias("b"))).select(F.split("node", "\x01")[0].alias("network"), "component").groupBy("network").agg(F.countDistinct("component").alias("components"))
    n = g.nodes.groupBy("network").agg(F.count("*").alias("nodes"), F.expr("cast(sum(degree) div 2 as bigint)").alias("edges"))
    c = clustering(e, g, weighted=True).groupBy("network").agg(F.avg("clustering").alias("c"))
    q = modularity(e, g, communities(e, g) if place is None else place)
    density = 2 * F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1))
    out = n.join(parts, "network").join(c, "network").join(q, "network").select("network", "nodes", "edges", F.round(density, 8).alias("density"), "components", F.round("c", 8).alias("average_clustering"), F.round("modularity", 8).alias("modularity"))
    return _here(out, edges)


# random graphs

_WALK, _HALVES = 17, 6


def random_edges(graphs: DataFrame) -> DataFrame:
    """(network, a, b, w) of seeded random graphs (network, seed, nodes, edges): that many different pairs of nodes, each set as likely as any other.

    The i-th edge is the i-th number of a permutation of all pairs. The permutation is a product of steps on the two digits of a
    number in bases whose product exceeds the number of pairs by less than their root; numbers beyond are permuted again. So edges are
    made where they are needed, and no graph is held anywhere.
    """
    g = graphs.select("network", "seed", "nodes", F.least("edges", F.expr("nodes * (nodes - 1) div 2")).alias("edges"), F.expr("nodes * (nodes - 1) div 2").alias("pairs")).where("edges > 0")
    g = g.withColumn("p", F.ceil(F.sqrt("pairs")).cast("long")).withColumn("q", F.expr("(pairs + p - 1) div p"))
    runs = g.withColumn("from", F.explode(F.expr("sequence(0L, edges - 1, 4096L)")))
    i = runs.repartition("network", "seed", "from").withColumn("i", F.explode(F.expr("sequence(from, least(from + 4096, edges) - 1)")))

    def once(x: Column) -> Column:
        state = F.struct((x % F.col("p")).alias("l"), F.floor(x / F.col("p")).alias("r"))

        def half(s: Column, k: Column) -> Column:
            mix = lambda v, base: F.pmod(F.xxhash64("seed", "network", k, v), F.col(base))
            left = (s["l"] + mix(s["r"], "p")) % F.col("p")
            right = (s["r"] + mix(s["l"], "q")) % F.col("q")
            return F.struct(F.when(k % 2 == 0, left).otherwise(s["l"]).alias("l"), F.when(k % 2 == 1, right).otherwise(s["r"]).alias("r"))

        return F.aggregate(F.array(*[F.lit(k) for k in range(_HALVES)]), state, half, lambda s: s["r"] * F.col("p") + s["l"])

    x = i.withColumn("x", once(F.col("i")))
    beyond = F.aggregate(F.array(*[F.lit(k) for k in range(_WALK)]), F.col("x"), lambda v, _: F.when(v < F.col("pairs"), v).otherwise(once(v)))
    x = x.withColumn("x", F.when(F.col("x") < F.col("pairs"), F.col("x")).otherwise(beyond))
    x = x.withColumn("b", F.floor((1 + F.sqrt(1 + 8 * F.col("x").cast("double"))) / 2))
    # the root may be off by one at the border of two numbers
    below = lambda c: F.expr(f"{c} * ({c} - 1) div 2")
    x = x.withColumn("b", F.when(below("b") > F.col("x"), F.col("b") - 1).when(below("(b + 1)") <= F.col("x"), F.col("b") + 1).otherwise(F.col("b")))
    return x.select("network", F.col("b").cast("string").alias("b"), (F.col("x") - below("b")).cast("string").alias("a"), F.lit(UNITS).cast("long").alias("w"))


def sensitivity(edges: DataFrame, levels: tuple = (1, 2, 3), runs: int = 10, seed: int = 1_000) -> DataFrame:
    """Per network and smallest weight: nodes, edges, density, mean clustering, and its mean and z among random graphs of that size.

    Random graphs are drawn for networks of any size; all of them, of all networks and weights, are one table of edges.
    """
    e = edges.select(F.col("network").cast("string").alias("of"), "a", "b", "weight", F.explode(F.array(*map(F.lit, levels))).alias("threshold")).where("weight >= threshold")
    each = hold(undirected(e.select(F.concat_ws("\x01", "of", "threshold").alias("network"), "a", "b", F.lit(1.0).alias("weight"))).withColumn("w", F.lit(UNITS).cast("long")))
    mean = lambda c: c.groupBy("network").agg(F.avg("clustering").alias("c"))
    g = Graph(each)
    size = hold(g.nodes.groupBy("network").agg(F.count("*").alias("nodes"), F.expr("cast(sum(degree) div 2 as bigint)").alias("edges")).join(mean(clustering(each, g)), "network"))
    drawn = size.where("nodes >= 2").select("network", "nodes", "edges", F.explode(F.sequence(F.lit(seed), F.lit(seed + runs - 1))).alias("seed"))
    drawn = hold(drawn.withColumn("network", F.concat_ws("\x01", "network", "seed")))
    null = hold(random_edges(drawn))
    own = drawn.select("network", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1)).alias("node")).select("network", F.col("node").cast("string").alias("node"))
    c = mean(clustering(null, Graph(null, isolated=own)))
    of = c.withColumn("network", F.substring_index("network", "\x01", 2)).groupBy("network").agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("sd"), F.count("*").alias("n"))
    density = 2 * F.col("edges") / F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1))
    z = F.when(F.col("sd") > 0, F.round((F.col("c") - F.col("m")) / F.col("sd"), 6))
    parts = F.split("network", "\x01")
    return size.join(of, "network", "left").select(
        parts[0].alias("network"), parts[1].cast("long").alias("threshold"), "nodes", "edges", F.round(density, 6).alias("density"), F.round("c", 6).alias("clustering"),
        F.round(F.coalesce("m", F.lit(0.0)), 6).alias("null_mean"), z.alias("null_z"), F.coalesce("n", F.lit(0).cast("long")).alias("null_runs"),
    )
