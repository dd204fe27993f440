"""Corpus operators against versions in plain Python loops, columns of awkward names, and rows that share an id."""

import collections
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from litweave.llm import common, embeddings, fingerprints, minhash, packing, quality, secrets, token_tree, tokens, toxicity

AWKWARD = "doc_id long, text string, `a.b` string, _masked string, _score double, _digest string, n_chars int"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def awkward(spark, texts):
    return spark.createDataFrame([(i, t, f"x{i}", f"own {i}", 0.25 * i, f"d{i}", len(t or "")) for i, t in texts], AWKWARD)


# shared parts


def test_portions_hold_every_row_and_few_characters():
    import pandas as pd

    texts = ["a" * n for n in (5, 0, 900, 3, 3, 3, 1, 400, 400, 400)] + [None, "b"]
    parts = list(common.portions([pd.DataFrame({"text": texts}), pd.DataFrame({"text": []})], most=1_000))
    assert [t for p in parts for t in p["text"]] == texts
    assert all(len(p) == 1 or sum(len(t or "") for t in p["text"]) <= 1_000 for p in parts)


def test_tables_can_be_dropped(spark):
    import os

    t = common.Cut(spark.range(5))
    assert t.df.count() == 5 and os.path.isdir(t.path)
    t.drop()
    assert not os.path.exists(t.path)


# 1 token counts


def test_edited_counts_are_those_of_the_edited_text(spark):
    from tokenizers import Tokenizer

    from litweave.llm.op1 import three_edits

    encoder = Tokenizer.from_file(tokens.public_path())
    encoder.encode_special_tokens = True
    texts = [(i, words(n, n)) for i, n in enumerate((0, 1, 3, 50, 400))] + [(9, None), (9, "é漢字 it's  <|endoftext|>\n\n x")]
    d = three_edits(spark.createDataFrame(texts, "doc_id long, text string"))
    plain = []
    for r in d.collect():
        t = r["text"] or ""
        for e in r["edits"]:
            t = t[: e["start"]] + e["text"] + t[max(e["stop"], e["start"]) :]
        plain.append((r["doc_id"], len(t), len(encoder.encode(t, add_special_tokens=False).ids)))
    assert sorted(map(tuple, token_tree.edited_counts(d).select("doc_id", "edited_chars", "edited_tokens").collect())) == sorted(plain)


def test_small_edits_after_a_large_insert_read_little():
    ids = tokens.Ids(tokens.public_path(), special_as_text=True)
    counts, text = token_tree.Counts(ids), words(200, 1)
    tree = token_tree.TokenTree(ids.words(text), counts)
    new = " " + words(20_000, 2) + " "
    tree.edit(500, 500, new)
    text = text[:500] + new + text[500:]
    for at in (600, 50_000, 90_000, 700):
        assert tree.edit(at, at + 1, "x") < 40
        text = text[:at] + "x" + text[at + 1 :]
    assert tree.edit(10, len(text) - 10, "") < 40  # nearly all leaves are empty now, and dropped
    assert tree.text() == text[:10] + text[-10:] and len(tree.leaf) < 100 and tree.tokens == len(ids.encode(tree.text()))


# 2 secrets


def test_private_keys_are_whole():
    key = "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n" + ("MIIEabc+/" * 7 + "\n") * 5 + "abc=\n-----END RSA PRIVATE KEY-----"
    open_ended = "-----BEGIN PRIVATE KEY-----\n" + "A" * 64 + "\n" + "B" * 64
    for text, want in ((f"é {key} after", "é [pem] after"), (f"{open_ended}\nplain words", "[pem]\nplain words"), ("-----BEGIN PRIVATE KEY----- no key", "[pem] no key"), (key + "\n" + key, "[pem]\n[pem]")):
        found = [f for f in secrets.scan([text])[0] if f[2] == "pem"]
        assert secrets.mask(text, found) == want


def test_every_kind_is_found():
    some = {
        "github": "ghp_" + "a1" * 18, "slack": "xoxb-1234567890-abc", "google": "AIza" + "Ab1" * 12, "github_pat": "github_pat_" + "A1b" * 10, "gitlab": "glpat-" + "x1" * 10,
        "npm": "npm_" + "a" * 36, "stripe": "sk_live_" + "Z9" * 8, "sendgrid": "SG." + "a" * 20 + "." + "b" * 20, "jwt": "eyJ" + "a" * 15 + ".eyJ" + "b" * 15 + ".c" * 1 + "d" * 8, "url": "://bob:pw12345@",
    }
    for kind, text in some.items():
        assert any(f[2] == kind for f in secrets.scan([f"漢 go {text} there"])[0]), kind
        assert not any(f[2] == kind for f in secrets.scan([f"go {text[:5]} there"])[0])


# columns of other names


def test_columns_of_any_name_stay(spark):
    rows = [(i, words(40, i) + (" password=hunter22" if i % 3 == 0 else "")) for i in range(12)] + [(3, words(40, 3) + " password=hunter22"), (20, None), (21, "")]
    d = awkward(spark, rows)
    own = {(r["doc_id"], r["a.b"], r["_masked"], r["_score"], r["_digest"]) for r in d.collect()}
    masked = secrets.mask_secrets(d)
    assert masked.schema == d.schema and {(r["doc_id"], r["a.b"], r["_masked"], r["_score"], r["_digest"]) for r in masked.collect()} == own
    assert all("hunter22" not in (r["text"] or "") and r["n_chars"] == len(r["text"] or "") for r in masked.collect())
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(12)], "doc_id long, toxic int")
    kept = toxicity.clean(d, labels, 1.1)
    assert kept.schema == d.schema and sorted(map(tuple, kept.collect()), key=repr) == sorted(map(tuple, d.collect()), key=repr)
    single = minhash.one_of_each(d)
    assert single.schema == d.schema and {(r["doc_id"], r["a.b"], r["_masked"], r["_score"], r["_digest"]) for r in single.collect()} == own


# 3 toxicity


def rows_of(seed, n, width, least=0):
    r = np.random.default_rng(seed)
    return [np.flatnonzero(r.random(width) < 0.3).astype(np.int64) if k >= least else np.empty(0, np.int64) for k in range(n)]


def plain_risk(pos, unl, prior, w, b):
    g = lambda row: b + sum(w[j] for j in row)
    toxic = prior * sum(math.log1p(math.exp(-g(r))) for r in pos) / len(pos)
    return toxic, sum(math.log1p(math.exp(g(r))) for r in unl) / len(unl) - prior * sum(math.log1p(math.exp(g(r))) for r in pos) / len(pos)


@pytest.mark.parametrize("prior", [0.1, 0.95])
def test_risk_and_gradient(prior):
    pos, unl, rng = rows_of(1, 9, 6, 1), rows_of(2, 30, 6, 2), np.random.default_rng(3)
    p, u = toxicity.Rows.of_lists(pos, 6), toxicity.Rows.of_lists(unl, 6)
    seen_negative = False
    for _ in range(20):
        w, b = rng.normal(size=6), float(rng.normal())
        toxic, clean, grad = toxicity.risk(p, toxicity.as_clean(u, w, b), prior, w, b)
        assert (toxic, clean) == pytest.approx(plain_risk(pos, unl, prior, w, b))
        seen_negative |= clean < 0

        def goal(w, b, clean=clean):
            t, c = plain_risk(pos, unl, prior, w, b)
            return t + c if clean >= 0 else -c

        want = [(goal(w, b + 1e-6) - goal(w, b - 1e-6)) / 2e-6]
        for j in range(6):
            e = np.eye(6)[j] * 1e-6
            want.append((goal(w + e, b) - goal(w - e, b)) / 2e-6)
        assert grad == pytest.approx(want, abs=1e-5)
    assert seen_negative == (prior > 0.5)


def test_best_shift_is_the_best():
    r = np.random.default_rng(5)
    pos, every, share = r.normal(1, 1, 40), r.normal(-2, 1, 500), 0.15
    edge = math.log(0.3 / 0.7)
    over = np.array([(every + s >= edge).sum() for s in toxicity.SHIFTS])

    def f1(s):
        recall = sum(x + s >= edge for x in pos) / len(pos)
        found = sum(x + s >= edge for x in every) / len(every)
        return 2 * min(share * recall, found) / (share + found)

    got = toxicity.best_shift(pos, over, len(every), share, 0.3)
    best = max(map(f1, toxicity.SHIFTS.tolist()))
    around = [s for s in toxicity.SHIFTS.tolist() if f1(s) >= best - toxicity.NEAR_BEST]  # here they hang together
    assert f1(got) >= best - toxicity.NEAR_BEST and got == pytest.approx((min(around) + max(around)) / 2)
    assert toxicity.best_shift(pos[:0], over, 5, 0.1, 0.3) == 0 == toxicity.best_shift(pos, over * 0, 0, 0.1, 0.3)


def test_sums_over_blocks_are_sums_over_rows(spark):
    columns, w = np.sort(np.array(toxicity.features("terrible") + toxicity.features("awfully"))), np.random.default_rng(8).normal(size=6)
    texts = [words(5, i) + (" terrible" if i % 3 == 0 else " awful" if i % 3 == 1 else " awfully terribly") for i in range(40)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    blocks = toxicity.blocks_of(d, columns, F.when(F.col("doc_id") % 4 > 0, (F.col("doc_id") % 3).cast("int")))
    rows = {i: [j for j, f in enumerate(columns.tolist()) if f in {g for x in (t or "").split() for g in toxicity.features(x)}] for i, t in enumerate(texts)}
    part = {i: i % 3 for i in rows if i % 4}
    for k in range(3):
        got = toxicity.added(blocks.df.where("part >= 0"), lambda own, x, k=k: toxicity.as_clean(x, w, 0.3) if own == k else np.zeros(9), 6, 9)
        assert got == pytest.approx(toxicity.as_clean(toxicity.Rows.of_lists([np.array(rows[i], int) for i in part if part[i] == k], 6), w, 0.3), rel=1e-5)
    assert toxicity.added(blocks.df.limit(0), lambda own, x: np.ones(9), 6, 9) == pytest.approx(np.zeros(9))
    scored = toxicity.Learned(columns, w, -0.5, blocks).scores().collect()
    assert {r["doc_id"]: r["score"] for r in scored} == pytest.approx({i: 1 / (1 + math.exp(0.5 - sum(w[j] for j in x))) for i, x in rows.items()}) and len(scored) == 42


def test_scores_are_sums_of_weights(spark):
    model = ({f: 0.5 + i for i, f in enumerate(toxicity.features("terrible"))}, -1.0)
    d = spark.createDataFrame([(1, "a terrible Terrible day"), (2, "terri fied"), (3, None), (4, "terribly")], "doc_id long, text string")
    got = {r["doc_id"]: r["s"] for r in d.select("doc_id", toxicity.scorer(model)("text").alias("s")).collect()}
    plain = {i: 1 / (1 + math.exp(-(-1.0 + sum(model[0].get(f, 0) for f in {f for w in (t or "").lower().split() for f in toxicity.features(w)})))) for i, t in ((1, "a terrible terrible day"), (2, "terri fied"), (3, ""), (4, "terribly"))}
    assert got == pytest.approx(plain)


# 8 quality


def test_context_vectors_are_sums_of_neighbours(spark, monkeypatch):
    texts = [words(30, i, 25).replace("w3", "W3!") for i in range(7)] + ["", None, "one", "same same same"]
    d = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = np.zeros((quality.BUCKETS, quality.DIMS))
    for t in texts:
        ids = quality.numbers(t, quality.Buckets()).tolist()
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if i != j and abs(i - j) <= quality.REACH:
                    want[a] += quality.INDEX[b]
    with monkeypatch.context() as m:
        m.setattr(quality, "AT_ONCE", 7)
        rows = pd.concat(quality._contexts(iter([pd.DataFrame({"text": texts})])))
        sums = np.frombuffer(b"".join(rows["sums"]), np.float32).reshape(want.shape)
        assert np.allclose(sums[1:], want[1:])
    want /= np.linalg.norm(want, axis=1, keepdims=True) + 1e-9
    got = quality.word_vectors(d)
    assert np.array_equal(got[:, : quality.DIMS], quality.INDEX)
    assert np.allclose(got[1:, quality.DIMS :], want[1:], atol=1e-4)  # the gap between texts is no word
    vectors = np.random.default_rng(1).normal(size=(quality.BUCKETS, 6)).astype(np.float32)
    for t in texts:
        ids = quality.numbers(t, quality.Buckets()).tolist()
        mean = [sum(float(vectors[i, k]) for i in ids) / max(1, len(ids)) for k in range(6)]
        assert quality.pooled(t, vectors, quality.Buckets()) == pytest.approx([*mean, math.log1p(len(ids)) / 8], abs=1e-4)


def test_network_and_temperature():
    r = np.random.default_rng(2)
    x = r.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + r.normal(scale=0.7, size=400) > 0).astype(float)
    net = quality.Network(x, y)
    w1, b1, w2, b2 = net.p
    for row in x[:10]:
        z = [(v - m) / s for v, m, s in zip(row, net.mean, net.scale, strict=True)]
        h = [math.tanh(sum(z[i] * w1[i, k] for i in range(5)) + b1[k]) for k in range(quality.HIDDEN)]
        logit = sum(a * b for a, b in zip(h, w2, strict=True)) + b2[0]
        assert net.score(row[None])[0] == pytest.approx(1 / (1 + math.exp(-logit / net.temperature)))
    order = np.random.default_rng(quality.SEED).permutation(400)[:80]
    f = net.logit(x[order])
    loss = lambda c: sum(math.log1p(math.exp(-(2 * t - 1) * v / c)) for t, v in zip(y[order], f, strict=True))
    assert all(loss(net.temperature) <= loss(c) + 1e-9 for c in np.geomspace(0.25, 20, 60))
    assert np.mean((net.score(x) > 0.5) == y) > 0.8


# 4 mixing


def test_mix_in_small_shards_and_runs(spark):
    """Sources, runs of shards and shards by highest quotients one by one."""
    from litweave.llm import mixing

    texts = [(i, words(20 + i % 60, i), f"s{i % 7 % 3}") for i in range(240)]
    d = spark.createDataFrame(texts, "doc_id long, text string, source string")
    kw = {"block_words": 16, "shard_docs": 4, "shards_at_once": 3}
    got = {r["doc_id"]: r for r in mixing.mix(d, **kw).collect()}
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(9), **kw).collect()}
    sizes = {i: len(t.split()) for i, t, _ in texts}
    assert all(r["size"] == sizes[i] and 0 <= r["taken"] <= 2 * sizes[i] for i, r in got.items())

    def seats(weights, n):
        have = dict.fromkeys(weights, 0)
        for _ in range(n):
            have[max(weights, key=lambda k: (weights[k] / (2 * have[k] + 1), [-x if isinstance(x, int) else x for x in k]))] += 1
        return have

    import hashlib

    h = lambda *p: int(hashlib.md5("|".join(map(str, p)).encode()).hexdigest()[:13], 16)
    of = {i: s for i, _, s in texts}
    target = {r_s: next(r["target"] for i, r in got.items() if of[i] == r_s) for r_s in sorted(set(of.values()))}
    blocks = seats({(s,): t for s, t in target.items()}, round(sum(target.values()) / 16))
    for s in target:
        docs = [i for i in of if of[i] == s]
        shards = -(-len(docs) // 4)
        weight = collections.Counter()
        for i in docs:
            weight[h("mix-1", i) % shards] += sizes[i]
        runs = collections.Counter()
        for k, w in weight.items():
            runs[k // 3] += w
        run_blocks = seats({(k,): w for k, w in runs.items()}, blocks[s,])
        for run in runs:
            own = {(k,): w for k, w in weight.items() if k // 3 == run}
            for (k,), quota in seats(own, run_blocks[run,]).items():
                taken = sum(got[i]["taken"] for i in docs if h("mix-1", i) % shards == k)
                quota = min(quota, 2 * -(-weight[k] // 16))
                assert abs(taken - 16 * quota) < 2 * 16, (s, k)


# 6 and 7 near duplicates of rows that share an id


def components(n, links):
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(i) for i in range(n)]


def jaccard(a, b):
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return bool(sets[0]) and bool(sets[1]) and 100 * len(sets[0] & sets[1]) >= 75 * len(sets[0] | sets[1])


def check_near(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string")
    n = len(rows)
    same_text = [(i, j) for i in range(n) for j in range(i) if jaccard(rows[i][1], rows[j][1])]
    by_id = components(n, same_text + [(i, j) for i in range(n) for j in range(i) if rows[i][0] == rows[j][0]])
    low = {c: min(rows[i][0] for i in range(n) if by_id[i] == c) for c in set(by_id)}
    want = {rows[i][0]: low[by_id[i]] for i in range(n)}
    got = minhash.near_duplicates(d).collect()
    assert len(got) == n and {r["doc_id"]: r["component_id"] for r in got} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert all(want[r["doc_id"]] == r["component_id"] for r in got)
    # of each group of texts one row stays, of the smallest id; texts without words stay, one for each id
    by_text = components(n, same_text)
    left = [tuple(r) for r in minhash.one_of_each(d).collect()]
    assert all(t in {(i, x) for i, x in rows} for t in left)
    for c in set(by_text):
        members = [rows[i] for i in range(n) if by_text[i] == c]
        if members[0][1].split():
            stay = [t for t in left if t in members]
            assert len(stay) == 1 and stay[0][0] == min(i for i, _ in members)
    assert sorted(t for t in left if not t[1].split()) == sorted({(i, x) for i, x in rows if not x.split()})


def test_rows_that_share_an_id(spark):
    a, b = words(60, 1), words(60, 2)
    check_near(spark, [(1, b), (3, a), (3, b), (7, a + " tail")])
    r = random.Random(4)
    base = [words(40, 10 + k) for k in range(6)]
    check_near(spark, [(r.randrange(14), r.choice(base) + r.choice(["", " x", " y z"])) for _ in range(30)] + [(50, ""), (50, ""), (51, "a b"), (51, "a b"), (2, "")])


def test_vectors_that_share_an_id(spark):
    y, x = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, y), (3, x), (3, y), (7, [0.0, 1.0, 0.01]), (8, [0.0, 0.0, 1.0])]
    for kind in ("double", "float"):
        got = embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
        assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == [(1, 1, 1, True), (3, 1, 1, False), (3, 1, 1, False), (7, 1, 1, False), (8, 0, 8, True)]
    r = np.random.default_rng(6)
    centre = r.normal(size=(5, 6))
    v = [(int(r.integers(0, 40)), (centre[r.integers(0, 5)] + r.normal(scale=0.18, size=6)).tolist()) for _ in range(70)]
    u = np.array([x for _, x in v])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    comp = components(70, [(i, j) for i in range(70) for j in range(i) if near[i, j] or v[i][0] == v[j][0]])
    low = {c: min(v[i][0] for i in range(70) if comp[i] == c) for c in set(comp)}
    want = sorted((v[i][0], int(near[i].sum()) - 1, low[comp[i]]) for i in range(70))
    for kw in ({}, {"per_cell": 4, "block_size": 3}):
        got = embeddings.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>"), **kw).collect()
        assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == want


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Near copies that no leader ties together are found by pairs of small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "LEADERS", 1)
    base, texts = words(60, 3).split(), []
    for k in range(45):
        at = random.Random(k).randrange(0, 55)
        texts.append((k, " ".join([*base[:at], f"n{k}", f"m{k}", f"o{k}", *base[at + 1 :]])))
    check_near(spark, texts)


# 9 packing


def piece_by_piece(lengths, size):
    """Best-two-fit, one piece at a time."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        items, gap = [], size
        while fits := [x for x in left if x <= gap]:
            items.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and len(items) > 1:
            small, pairs = items[-1], []
            have = sorted(x for x in left if 2 * x >= small)
            for i, a in enumerate(have):
                pairs += [(a + b, a) for b in have[i + 1 :] if small < a + b <= gap + small]
            if pairs:
                total, a = max(pairs)  # the largest sum, of equal ones the one of the most equal parts
                items.pop()
                left.append(small)
                for x in (a, total - a):
                    left.remove(x)
                    items.append(x)
                left.sort(reverse=True)
        bins.append(tuple(sorted(items)))
    return sorted(bins)


def test_plans_are_those_made_piece_by_piece():
    r = random.Random(12)
    for k in range(60):
        size = r.choice([20, 64, 200])
        lengths = [r.randint(1, size) if r.random() < 0.6 else r.randint(1, max(1, size // 4)) for _ in range(r.randint(0, 90))]
        plan = packing.plan(collections.Counter(lengths), size)
        assert sorted(tuple(sorted(items)) for items, n in plan for _ in range(n)) == piece_by_piece(lengths, size), k


def test_salts_do_not_change_the_layout(spark, monkeypatch):
    monkeypatch.setattr(packing, "PER_SALT", 2)
    d = spark.createDataFrame([(i, words(5 + i % 7, i % 9)) for i in range(120)], "doc_id long, text string").repartition(4)
    at = collections.defaultdict(list)
    for r in packing.pack(d, size=64).collect():
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in at.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 64


# 10 fingerprints


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def xx(data, seed=42):
    return signed(xxhash.xxh64(data, seed=seed & (1 << 64) - 1).intdigest())


def xx_list(hashes, seed=42):
    for h in hashes:
        seed = xx(struct.pack("<q", h), seed)
    return seed


def plain_signature(text, lexicon):
    import re

    every = {xx(w.encode()) for w in re.split(fingerprints.BETWEEN, text.lower()) if w}
    kept = sorted(every & lexicon)
    out = [xx_list(kept) if kept else xx_list(sorted(every), xx(b"no lexicon term"))]
    shift = 15
    for thin, parts in fingerprints.DENSITIES:
        base = [h for h in kept if (h >> shift) & ((1 << thin) - 1) == 0]
        for p in range(parts):
            own = [h for h in base if (h >> (shift + thin)) & (parts - 1) == p]
            out.append(xx_list(own) if own else 0)
        shift += thin + 4
    for p in range(fingerprints.ALL_PARTS):
        own = [h for h in sorted(every) if (h >> shift) & (fingerprints.ALL_PARTS - 1) == p]
        out.append(xx_list(own) if own and len(every) <= fingerprints.SHORT_TERMS else 0)
    return out


def plain_likeness(a, b):
    some = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
    return sum(x == y for x, y in some) / len(some)


def test_fingerprints_against_plain_python(spark):
    import re

    texts = {i: words(60 if i % 3 else 150, i, 90) if i % 8 else ("rare" + str(i) if i % 16 else "") for i in range(40)}
    df = collections.Counter(w for t in texts.values() for w in {w for w in re.split(fingerprints.BETWEEN, t.lower()) if w})
    low, high = 0.1, 0.6
    lexicon = {xx(w.encode()) for w, n in df.items() if low * 40 <= n <= high * 40}
    sig = {i: plain_signature(t, lexicon) for i, t in texts.items()}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for r in fingerprints.fingerprints_with_edit(d, low, high).collect():
        i = r["doc_id"]
        half, following = len(texts[i]) // 2, (i + 1) % 40
        edited = plain_signature(texts[i][: len(texts[i]) - half] + texts[following][:half], lexicon)
        assert list(r["sig"]) == sig[i] and list(r["edited_sig"]) == edited
        assert r["near_edited"] == pytest.approx(plain_likeness(sig[i], edited)) and r["near_next"] == pytest.approx(plain_likeness(sig[i], sig[following]))


# the pipeline


def test_stages_against_plain_python(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(3)
    docs = [(i, words(30 + i % 50, i % 70) + (" vile scum" if i % 9 == 0 else "") + (" token=abcdef123" if i % 5 == 0 else ""), f"s{i % 3}", "en", 0) for i in range(160)]
    docs += [(200, None, "s0", "en", 0), (201, "", None, "en", 0), (202, "   ", "s1", "en", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(160) if r.random() < 0.8], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    read = common.table(spark, str(tmp_path), "documents")
    stages = dict(corpus_pipeline.STAGES)
    # toxicity: no document without the words goes, most with them do
    kept = common.cut(stages["toxicity"](spark, read, str(tmp_path)))
    ids = {x["doc_id"] for x in kept.collect()}
    assert {i for i, t, *_ in docs if "vile" not in (t or "")} <= ids and len(ids & {i for i in range(0, 160, 9)}) <= 3
    # near duplicates: of each group the smallest id
    texts = {x["doc_id"]: x["text"] or "" for x in kept.collect()}
    order = sorted(texts)
    comp = components(len(order), [(a, b) for a in range(len(order)) for b in range(a) if jaccard(texts[order[a]], texts[order[b]])])
    single = common.cut(stages["near_dedup"](spark, kept, str(tmp_path)))
    assert {x["doc_id"] for x in single.collect()} == {order[i] for i in set(comp)}
    # secrets
    safe = common.cut(stages["secrets"](spark, single, str(tmp_path)))
    want = {x["doc_id"]: x["text"] and x["text"].replace("token=abcdef123", "[assign]") for x in single.collect()}
    assert {x["doc_id"]: x["text"] for x in safe.collect()} == want
    # mixing: 150 % of the words, 5 : 2 : 1, no document more than twice, targets at most twice their source
    mixed = common.cut(stages["mixing"](spark, safe, str(tmp_path)))
    size, got, of = collections.Counter(), collections.Counter(), {x["doc_id"]: x["source"] for x in safe.collect()}
    for x in safe.collect():
        size[x["source"]] += len((x["text"] or "").split())
    for x in mixed.collect():
        got[of[x["doc_id"]]] += len(x["text"].split())
    weights = dict(zip(["s0", "s1", "s2", None], (5, 2, 1, 5), strict=True))
    target, open_, budget = {}, {s: w for s, w in weights.items()}, 1.5 * sum(size.values())
    while open_:
        level = (budget - sum(target.values())) / sum(open_.values())
        over = [s for s, w in open_.items() if level * w >= 2 * size[s]]
        for s in over or list(open_):
            target[s] = 2 * size[s] if over else level * open_[s]
            del open_[s]
    assert all(abs(got[s] - t) <= 2 * 64 for s, t in target.items())
    # packing: every piece once, in as many sequences as piece by piece
    packed = stages["packing"](spark, mixed, str(tmp_path)).collect()
    assert len({x["sequence_id"] for x in packed}) == len(piece_by_piece([x["length"] for x in packed], 1024))
    ids_of = tokens.Ids(tokens.public_path())
    have = collections.Counter(zlib.crc32(raw + b"\2\0\0\0") for raw in ids_of([x["text"] for x in mixed.collect()]) if len(raw) < 4000)
    assert have == collections.Counter(x["ids_crc32"] for x in packed if x["length"] < 1000)
