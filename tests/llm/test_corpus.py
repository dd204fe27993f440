"""Corpus operators against plain Python, and on nulls, empty and long texts, repeats, empty tables and extra columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litweave.llm import automaton, embeddings, fingerprints, licences, minhash, mixing, packing, quality, secrets, token_tree, tokens, toxicity
from litweave.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, taken string"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [words(80, i) for i in range(8)]
    near = [base[0] + " extra", base[0].upper(), base[1].replace(" ", "\n", 5), " ".join(base[2].split()[:70])]
    odd = [None, "", "   ", "one", "one", "ONE", "two words", words(12000, 99), "a  b\t\tc \n\n d", "é漢字 𝒳 '\"<|endoftext|> x", "password = hunter22! token: abc, SECRET='abcdefgh' " + "ab" * 20]
    return [(i, t, "en", None if i % 7 == 3 else f"s{i % 3}", 0, 1.0, "x", "y") for i, t in enumerate(base + near + odd)] + [(3, base[3], "en", "s0", 0, 1.0, "x", "y"), (None, "no id here", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoder():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


def test_components(spark):
    r = random.Random(2)
    e = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500, i) for i in range(501, 560)] + [(None, 1)]
    up = {}

    def root(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in e:
        if a is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


# 1 token counts


def test_trees_follow_edits(encoder):
    ids = tokens.Ids(tokens.public_path(), special_as_text=True)
    counts, r = token_tree.Counts(ids), random.Random(3)
    encoder.encode_special_tokens = True
    bits = ["a", "the", " ", "  ", "\n", " it's", "'", "'re", "12", "é", "漢", "!?", "<|endoftext|>", "\t", " word", "   "]
    for _ in range(150):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 60)))
        tree = token_tree.TokenTree(ids.words(text) if text else [], counts)
        for _ in range(5):
            s = r.randint(0, len(text))
            e, new = min(len(text), s + r.randint(0, 8)), "".join(r.choice(bits) for _ in range(r.randint(0, 4)))
            text = text[:s] + new + text[e:]
            tree.edit(s, e, new)
            assert tree.text() == text and tree.chars == len(text)
            assert tree.tokens == len(encoder.encode(text, add_special_tokens=False).ids)
    encoder.encode_special_tokens = False


def test_edited_counts(docs, none, encoder):
    from litweave.llm.op1 import three_edits

    encoder.encode_special_tokens = True
    for r in token_tree.edited_counts(three_edits(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r["n_tokens"] == len(encoder.encode(r["text"] or "", add_special_tokens=False).ids) and r["n_chars"] == len(r["text"] or "")
    encoder.encode_special_tokens = False
    assert token_tree.edited_counts(three_edits(none)).count() == 0


# 2 secrets


def brute_secrets(t):
    out = [(m.start(), m.end(), "assign") for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
    return sorted(out, key=lambda x: (x[0], secrets.KINDS.index(x[2])))


def test_secrets_against_regex(docs, none, rows):
    r = random.Random(1)
    bits = ["password", "PassWD", "secret", "token", "api_key", "apikey", '"', "'", " ", "  ", ":", "=", "abc", "12345", "abcdef0123", "AKIA", "ABCDEFGHIJ", "0123456789abcdef", "zz", "é", "\n", "-", "漢", "TOKEN"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(2000)] + [None, "", "a" * 50_000]
    got = [[x for x in f if x[2] in secrets.BASE] for f in secrets.scan(texts)]
    assert got == [brute_secrets(t or "") for t in texts]
    by = {x[0]: x[1] for x in rows if x[0] is not None}
    for x in secrets.find_secrets(docs).collect():
        if x["doc_id"] is not None:
            base = brute_secrets(by[x["doc_id"]] or "")
            assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
            assert (x["n_assign"], x["n_access"], x["n_hex"]) == tuple(sum(b[2] == k for b in base) for k in secrets.BASE)
    assert secrets.find_secrets(none).count() == 0 == secrets.mask_secrets(none).count()


def test_masks_keep_rows_and_columns(docs):
    m = secrets.mask_secrets(docs)
    assert m.schema == docs.schema and m.count() == docs.count()
    texts = [r["text"] for r in m.where("text like '%[assign]%'").collect()]
    assert texts and all("hunter22" not in t and "abcdefgh" not in t for t in texts)


def test_automaton_is_minimal_and_right():
    d = automaton.compile_dfa([("a(b|c)*d{2,3}", False)], False)
    assert automaton.spans(d, b"xabcbddd-add ad") == [(1, 8), (9, 12)]
    assert len(automaton.compile_dfa([("ab|cb", False)], False).accepts) == 4


# 3 and 8 classifiers


def labelled(spark, toxic):
    r, docs, labels = random.Random(4), [], []
    for i in range(400):
        y = int(r.random() < 0.3)
        bad = " ".join(r.choice(["vile", "scummy", "hateful"]) for _ in range(4)) if toxic else "%%% $$$ ### %%%"
        good = y if toxic else 1 - y
        docs.append((i, words(40, i, 300) + (" " + bad if good else "")))
        if i % 2 == 0 or not toxic:
            labels.append((i, y, y))
    d = spark.createDataFrame([*docs, (9001, None), (9002, ""), (None, "x y")], "doc_id long, text string")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: q for i, q, _ in labels}


@pytest.mark.parametrize("name", ["toxic", "quality"])
def test_held_out_rows_are_told_apart(spark, none, name):
    d, labels, y = labelled(spark, name == "toxic")
    f, folds, rest = (toxicity.toxicity, 4, 2) if name == "toxic" else (quality.quality, 3, 1)
    got = f(d, labels).collect()
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % folds == rest) for r in got)
    held = [(r["score"], y[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in y]
    pairs = [(a > b) + (a == b) / 2 for a, p, _ in held if p for b, q, _ in held if not q]
    assert np.mean(pairs) > 0.95 and np.mean([p == q for _, p, q in held]) > 0.9
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.col("toxic"))
    assert sorted((r["score"] for r in f(d, flipped).collect())) == sorted(r["score"] for r in got)  # held-out labels are not read
    assert f(none, labels).count() == 0 and f(d, labels.limit(0)).count() == 403


# 4 mixing


def test_mix_is_near_its_targets(docs, none, spark):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=repr)
    big = spark.createDataFrame([(i, words(50 + i % 90, i), f"s{i % 4 * (i % 5 > 0)}") for i in range(600)], "doc_id long, text string, source string")
    by = collections.defaultdict(list)
    for r in mixing.mix(big).collect():
        by[r["target"]].append(r)
    total = sum(r["size"] for rs in by.values() for r in rs)
    assert sum(by) == pytest.approx(1.5 * total)
    for target, rs in by.items():
        assert target <= 2 * sum(r["size"] for r in rs) + 1e-6 and abs(sum(r["taken"] for r in rs) - target) <= 2 * mixing.BLOCK_WORDS
    assert mixing.mix(none).count() == 0 == mixing.mixed(none).count()


def test_apportionment_is_by_highest_quotients(spark):
    for seats, weights in ((7, [5.0, 3.0, 1.0]), (100, [1.0, 1.0, 97.5, 0.0]), (3, [2.0, 2.0, 2.0]), (1000, [float(i * i) for i in range(1, 30)])):
        df = spark.createDataFrame([(0, i, w, seats) for i, w in enumerate(weights)], "g int, i int, w double, seats long")
        got = {r["i"]: r["quota"] for r in mixing.apportion(df, ["g"], "w", "seats", ["i"]).collect()}
        want = collections.Counter()
        for _ in range(seats):
            want[max(range(len(weights)), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))] += 1
        assert got == {i: want[i] for i in range(len(weights))}


def test_mixed_texts_hold_the_words_taken(docs):
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mixed(docs)
    assert out.schema == docs.schema
    have = collections.Counter()
    for r in out.collect():
        have[r["doc_id"]] += len(r["text"].split())
    assert {k: v for k, v in taken.items() if v} == dict(have)


# 5 licences


def test_licences(docs, none, spark):
    t = licences.Templates()
    assert t.best(licences.bigrams(licences.words("released under the mit license!")))[1] == "MIT"
    r = random.Random(6)
    every = [licences.bigrams(licences.words(x)) for ts in licences.TEMPLATES.values() for x in ts]
    for _ in range(300):
        unit = set(r.sample(sorted(r.choice(every)), 2)) | (r.choice(every) if r.random() < 0.5 else set())
        top = max(2 * len(unit & b) / (len(unit) + len(b)) for b in every)
        assert (t.best(unit) or (0,))[0] == (top if top >= t.least else 0)
    d = spark.createDataFrame([(1, "x y and much more\nLicensed under CC BY-NC 4.0.\nz and the rest"), (2, "no licence here"), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((x["doc_id"], x["licence"], x["n_matches"]) for x in licences.find_licences(d).collect() if x["licence"]) == [(1, "CC-BY-NC-4.0", 1)]
    assert licences.find_licences(docs).count() == docs.count() and licences.find_licences(none).count() == 0


# 6 embeddings


def test_embeddings_lose_no_link(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(120, 8))
    x = np.vstack([x, x[:40] + r.normal(scale=0.12, size=(40, 8)), x[:10], np.repeat(x[:1], 30, axis=0) + r.normal(scale=0.05, size=(30, 8))])
    v = [(i, a.tolist()) for i, a in enumerate(x)]
    v += [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0, None] + [0.0] * 6), (905, [1.0, 0.0]), (906, [2.0, 0.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    up = list(range(len(x)))
    for _ in range(50):
        up = [min(up[j] for j in np.flatnonzero(link[i])) for i in range(len(x))]
    for kw in ({}, {"per_cell": 8, "block_size": 7}):
        got = embeddings.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<double>"), **kw).collect()
        assert len(got) == len(v)
        by = {g["vec_id"]: g for g in got}
        assert {i: by[i]["component_id"] for i in range(len(x))} == dict(enumerate(up))
        assert all(by[i]["n_links"] == link[i].sum() - 1 for i in range(len(x)) if i != 3 and not link[i, 3])
        assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in range(900, 905)) and by[906]["component_id"] == 905 and by[906]["n_links"] == 1
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


# 7 near duplicates


def brute_near(texts):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[^\x00-\x7f]", lambda m: m[0], t or ""))]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in texts}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates(docs, none, rows):
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    got = minhash.near_duplicates(docs).collect()
    want = brute_near(texts)
    assert len(got) == len(rows)
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got if r["doc_id"] is not None)
    left = minhash.one_of_each(docs)
    assert left.schema == docs.schema
    assert sorted(r["doc_id"] for r in left.where("doc_id is not null").collect()) == sorted(i for i, (_, c) in want.items() if i == c)
    assert minhash.near_duplicates(none).count() == 0 == minhash.one_of_each(none).count()


def test_a_group_whose_copies_are_unlike_each_other(spark):
    base, r, texts = words(60, 7).split(), random.Random(8), {}
    texts[0] = " ".join(base)
    for i in range(1, 60):
        k = r.randrange(5, 50)
        texts[i] = " ".join([*base[:k], f"x{i}", f"y{i}", *base[k:]])
    for i in range(60, 90):
        texts[i] = " ".join(base[: 30 + i % 20] + words(20, i).split())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_near(texts)


# 9 packing


def test_ids_are_the_tokenizer_s(encoder):
    ids = tokens.Ids(tokens.public_path())
    texts = ["", "  a b", "a  b\n\n c", "a<|endoftext|> b", "x\ty", "é ß z", "a\n", "\n", "it's\nwe'll d", "1²3   x", "\0a b\0 c", "漢字 　かな", "a\x1cb", words(500, 1)]
    assert ids(texts) == [np.array(encoder.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plans_hold_every_piece():
    r = random.Random(9)
    for _ in range(60):
        lengths = [min(1024, int(r.lognormvariate(5, 1.2)) + 1) for _ in range(r.randint(0, 300))]
        p = packing.plan(collections.Counter(lengths))
        assert all(sum(items) <= 1024 for items, _ in p)
        assert collections.Counter(x for items, n in p for x in items * n) == collections.Counter(lengths)
        assert not lengths or sum(n for _, n in p) <= 11 / 9 * -(-sum(lengths) // 1024) + 4


def test_packing(docs, none, rows, encoder):
    got = packing.pack(docs).collect()
    at, own = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        own[r["doc_id"]].append(r)
    for s in at.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 1024
    for i, text in {(r[0], r[1]) for r in rows if r[0] not in (3,)}:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(own[i], key=lambda r: r["piece"])
        assert [r["start"] for r in parts] == [0, *np.cumsum([r["length"] for r in parts])[:-1]] and sum(r["length"] for r in parts) == len(ids)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in parts)
        assert all(r["length"] == 1024 for r in parts[1:])
    assert packing.pack(none).count() == 0


# 10 fingerprints


def test_fingerprints(docs, none, spark):
    from litweave.llm.fingerprints import as_text

    got = fingerprints.fingerprints_with_edit(docs).collect()
    assert len(got) == docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    texts = {i: words(100, i, 500) if i % 9 else "same" for i in range(50)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    by = {}
    for r in fingerprints.fingerprints_with_edit(d).withColumn("f", as_text(F.col("sig"))).collect():
        t, following = texts[r["doc_id"]], texts[(r["doc_id"] + 1) % 50]
        half = len(t) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256((t[: len(t) - half] + following[:half]).encode()).hexdigest())
        assert by.setdefault(t, r["f"]) == r["f"]
    assert len(set(by.values())) == len(by)
    assert fingerprints.fingerprints_with_edit(none).count() == 0 == fingerprints.fingerprints(none).count()


def test_ranges_do_not_change_what_is_next(spark, monkeypatch):
    d = spark.createDataFrame([(i * 3 % 101, words(30, i)) for i in range(101)] + [(None, "last"), (5, "again")], "doc_id long, text string")
    seen = set()
    for n in (4000, 7):
        monkeypatch.setattr(fingerprints, "DOCS_PER_RANGE", n)
        seen.add(tuple(sorted((str(r["doc_id"]), r["edited_sha256"]) for r in fingerprints.fingerprints_with_edit(d).collect())))
    assert len(seen) == 1
