"""Licence notices amid lines and across them, and windows against all windows."""

import random
import time
import tracemalloc

from litweave.llm import licences


def test_notices_amid_a_line_and_across_lines(spark):
    rows = [
        (1, "Copyright 2020 Acme. All rights reserved.", {"Proprietary:0:1"}),
        (2, "See the docs. Licensed under the MIT License. Contributions welcome.", {"MIT:0:1"}),
        (3, "Many words come first and then it is licensed under the\nApache License, Version 2.0. Many more words follow here", {"Apache-2.0:0:2"}),
        (4, "x\n\nSome words before. Licensed under the BSD 3-Clause License. All rights reserved. Further words stand here", {"BSD-3-Clause:2:1", "Proprietary:2:1"}),
        (5, "one line\nLicensed under CC BY-NC 4.0.\nlast line", {"CC-BY-NC-4.0:1:1"}),
        (6, "all the rights that are reserved under the law of the land", {""}),
    ]
    got = licences.find_licences(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert {x["doc_id"]: set(x["matches"].split(",")) for x in got} == {i: m for i, _, m in rows}


def test_best_window_is_that_of_all_windows():
    t, r = licences.Templates(), random.Random(8)
    short = [licences.words(x) for ts in licences.TEMPLATES.values() for x in ts if len(x) < 90]
    for _ in range(60):
        w = []
        while len(w) < 40:
            x = r.choice(short)
            w += x[: r.randrange(1, len(x) + 1)] if r.random() < 0.5 else [r.choice([b"a", b"the", b"license"]) for _ in range(3)]
        units = [licences.bigrams(w[i:j]) for i in range(len(w)) for j in range(i + 2, len(w) + 1)]
        top = max(((t.best(u) or (0.0,))[0] for u in units), default=0.0)
        got = t.windows(w)
        assert max((x[3] for x in got), default=0.0) == top
        taken = [i for p, q, _, _ in got for i in range(p, q + 1)]
        assert len(taken) == len(set(taken))
    assert t.windows([b"all", b"rights", b"reserved"] * 2000).__len__() == 2000


def all_windows(t, w):
    """Every window that matches, start by start, then the best of all, the next that does not overlap it, and so on."""
    pairs, found = list(zip(w, w[1:])), []
    for i, (_, b) in enumerate(t.rows):
        for p in range(len(pairs)):
            for q in range(p, len(pairs)):
                unit = set(pairs[p : q + 1])
                ends = pairs[p] in b and pairs[q] in b and pairs[q] not in pairs[p:q] and pairs[p] not in pairs[p + 1 : q + 1]
                if ends and (dice := 2 * len(unit & b) / (len(unit) + len(b))) >= t.least:
                    found.append((-dice, -len(b), i, p, q + 1))
    taken, out = set(), []
    for dice, _, i, p, q in sorted(found):
        if not taken.intersection(range(p, q + 1)):
            taken.update(range(p, q + 1))
            out.append((p, q, t.rows[i][0], -dice))
    return sorted(out)


def test_windows_equal_all_windows_for_any_lots(monkeypatch):
    some = {k: [x for x in licences.TEMPLATES[k] if len(x) < 90][:6] for k in ("MIT", "Apache-2.0", "BSD-3-Clause", "Proprietary")}
    t, r = licences.Templates(some), random.Random(3)
    short = [licences.words(x) for ts in some.values() for x in ts]
    for n in range(25):
        w = []
        while len(w) < 60:
            x = r.choice(short)
            w += x[r.randrange(3) :] if r.random() < 0.7 else [r.choice([b"a", b"the", b"license"]) for _ in range(r.randrange(1, 9))]
        monkeypatch.setattr(licences, "STARTS", r.choice([1, 5, 16, 4096]))
        monkeypatch.setattr(licences, "CELLS", r.choice([1, 64, 1 << 20]))
        assert sorted(t.windows(w)) == all_windows(t, w)


def test_a_file_of_ten_thousand_notices():
    t = licences.Templates()
    long = max(licences.TEMPLATES["MIT"], key=len)
    w = licences.words(long)
    one = licences.Templates({"MIT": [long]})
    assert sorted(one.windows(w * 3)) == all_windows(one, w * 3)
    five = sorted(t.windows(w * 5))
    assert [(p // len(w), q // len(w), name, dice) for p, q, name, dice in five] == [(i, i, "MIT", 1.0) for i in range(5)]
    tracemalloc.start()
    start = time.time()
    got = t.windows(w * 200)
    assert len(got) == 200 and {x[3] for x in got} == {1.0}
    assert tracemalloc.get_traced_memory()[1] < 150e6 and time.time() - start < 60
    tracemalloc.stop()
    names = [f"Licensed under the {n}.\nCopyright {i} A. Uthor" for i in range(500) for ns in list(licences.NAMES.values())[:20] for n in ns[:1]]
    tracemalloc.start()
    found = t.scan("\n".join(names))
    assert len(found) >= 10_000 and tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_the_only_paragraph_is_the_text():
    t = licences.Templates()
    text = "Licensed under the\nMIT License.\n"
    assert [x[:3] for x in t.scan(text)] == [(0, 2, "MIT")] == [x[:3] for x in t.scan(text + "\n\n")]
