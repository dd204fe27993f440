"""Files by ranges of bytes against the parsers of whole files."""

import io
import random

import pytest

from litweave.sources import parsers as P
from litweave.sources import ranges as R
from tests.test_sources import BIB, NBIB, RIS, WOS

FILES = {
    "a.ris": "﻿" + RIS.replace("A title", "Über 标题") + "XX  - stray\n" + RIS.replace("\n", "\r\n") + "TY - x\nTI  - no dashes at TY  - \n  TY  - not a line of its own\n",
    "a.ciw": WOS + "EF\n" + WOS.replace("FN Clarivate\n", "") + "PTX\nPT J\nTI Last",
    "a.nbib": NBIB + "\n" + NBIB.replace("PMID- 1", "PMID - 1"),
    "a.enw": "%0 Journal Article\n%T One\n%A Lee, A\n%0 Book\n%T Two %0 not here\n%D 2011\n",
    "a.net": "{Reference Type}: Journal Article\n{Title}: Two\n{Author}: Lee, A\n\n{Reference Type}: Book\n{Title}: Three\n   and more\n",
    "a.bib": BIB + "\n@comment no entry\n@book{b,\n title={At @home},\n note={see @misc{x}}\n}\n @article{c, title={Indented}}\n",
    "a.jsonl": '{"title": "a b", "authors": [{"name": "Lee"}, "Doe"]}\n\n{"title": "ç", "year": 1999}\n{"title": "last"}',
    "none.ris": "no tags at all\nin this file\n",
    "empty.ris": "",
}


def ranged(name: str, content: bytes, cuts: list[int]) -> list[tuple]:
    edges = [0, *cuts, max(len(content), 1)]
    return [r for a, b in zip(edges, edges[1:], strict=False) for r in R.rows_of(name, io.BufferedReader(io.BytesIO(content)), a, b)]


@pytest.mark.parametrize("name", FILES)
def test_every_cut_gives_the_records_of_the_whole_file(name):
    content, rng = FILES[name].encode(), random.Random(1)
    whole = [(name, *P.parse(name, content)[:2], r) for r in P.parse(name, content)[2]]
    cuts = [[i] for i in range(1, len(content))] + [sorted(rng.sample(range(1, len(content)), 5)) for _ in range(30) if len(content) > 9]
    places = {tuple(r[1] for r in ranged(name, content, c)) for c in cuts}
    for c in cuts:
        assert [(n, kind, style, r) for n, _, kind, style, r, error in ranged(name, content, c) if error is None] == whole
    assert len(places) <= 1 and all(list(p) == sorted(set(p)) for p in places)


def test_a_malformed_line_is_an_error_of_its_own():
    rows = ranged("a.jsonl", b'{"title": "a"}\n{broken\n[1]\n{"title": "b"}\n', [16])
    assert [(r[4] and r[4]["title"], bool(r[5])) for r in rows] == [(["a"], False), (None, True), (None, True), (["b"], False)]


def test_many_tasks_read_one_file(spark, tmp_path):
    one = "TY  - JOUR\nTI  - Work {}\nAU  - Lee, A\nPY  - 2019\nAB  - " + "words of an abstract " * 20 + "\nER  - \n"
    (tmp_path / "sub").mkdir()
    (tmp_path / "big.ris").write_text("".join(one.format(i) for i in range(9000)))
    for i in range(40):
        (tmp_path / "sub" / f"s{i}.RIS").write_text(one.format(f"small {i}"))
    (tmp_path / "sub" / "t.csv").write_text("title,year\nIn a table,2003\n")
    (tmp_path / "x.json").write_text("{broken")
    (tmp_path / "y.txt").write_text("of no known format")
    (tmp_path / "z.pdf").write_text("not an export")
    raw = R.raw_ranges(spark, str(tmp_path), 1 << 19)
    assert raw.rdd.getNumPartitions() > 8
    rows = P.flat(raw).collect()
    assert sum(r["error"] is None for r in rows) == 9041 and len({r["title"] for r in rows if r["error"] is None}) == 9041
    assert {r["path"].rsplit("/", 1)[1] for r in rows if r["error"]} == {"x.json", "y.txt"}
    assert [r["title"] for r in sorted((r for r in rows if r["path"].endswith("big.ris")), key=lambda r: r["place"])] == [f"Work {i}" for i in range(9000)]
    small = P.read_exports(spark, [str(tmp_path / "sub" / "s*.RIS"), str(tmp_path / "sub" / "t.csv")])
    assert small.count() == 41
    with pytest.raises(FileNotFoundError):
        P.read_exports(spark, str(tmp_path / "nothing"))
