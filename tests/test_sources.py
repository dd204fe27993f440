"""Readers on small files written by hand."""

import json

from litweave.sources import parsers as P

RIS = "TY  - JOUR\nTI  - A title\nAU  - Lee, A\nAU  - Chen, B\nPY  - 2019/05/01\nKW  - one\nKW  - two\nN1  - Times Cited in Web of Science Core Collection: 12\nAN  - WOS:0001\nER  - \nTY  - JOUR\nAU  - Nobody\nER  - \n"
WOS = "FN Clarivate\nPT J\nAU Lee, A\n   Chen, B\nTI A long\n   title\nPY 2020\nTC 7\nUT WOS:9\nCR Smith 1999, 10.1234/x; Doe 2001\nER\n"
NBIB = "PMID- 1\nTI  - First\nFAU - Lee, A\nDP  - 2018 Jan\n\nPMID- 2\nTI  - Second\nLID - 10.1/abc\nDP  - 2019\n"
BIB = "@article{k, title = {A {Deep} title}, author = {Lee, A and Chen, B}, year = 2021, doi = \"10.1/Q\"}\n@misc{x, note={no title}}"


def read(spark, name, text):
    content = text if isinstance(text, bytes) else text.encode()
    return P.flat(P.raw_records(spark.createDataFrame([(name, content)], "path string, content binary"))).orderBy("place").collect()


def test_tagged_formats(spark):
    (r,) = read(spark, "a.ris", RIS)
    assert (r["title"], r["authors"], r["year"], r["publication_date"], r["keywords"], r["citations"], r["source"], r["wos_id"]) == ("A title", ["Lee, A", "Chen, B"], 2019, "", ["one", "two"], 12, "wos", "WOS:0001")
    (w,) = read(spark, "a.ciw", WOS)
    assert (w["title"], w["authors"], w["citations"], w["wos_id"]) == ("A long title", ["Lee, A", "Chen, B"], 7, "WOS:9")
    assert [(m["raw"], m["doi"], m["year"]) for m in w["reference_metadata"]] == [("Smith 1999, 10.1234/x", "10.1234/x", 1999), ("Doe 2001", None, 2001)]
    for name in ("a.nbib", "a.medline"):
        assert [(r["title"], r["year"], r["pmid"], r["doi"]) for r in read(spark, name, NBIB)] == [("First", 2018, "1", ""), ("Second", 2019, "2", "10.1/abc")]
    (e,) = read(spark, "a.enw", "%0 Journal Article\n%T One\n%A Lee, A\n%A Chen, B\n%D 2011\n%R 10.1/X\n")
    assert (e["title"], e["authors"], e["year"], e["doi"]) == ("One", ["Lee, A", "Chen, B"], 2011, "10.1/x")
    (n,) = read(spark, "a.net", "{Reference Type}: Journal Article\n{Title}: Two\n{Author}: Lee, A\n{Year}: 2012\n{Keywords}: a; b\n")
    assert (n["title"], n["year"], n["keywords"], n["source"]) == ("Two", 2012, ["a", "b"], "net")


def test_bibtex_table_and_json(spark):
    (b,) = read(spark, "a.bib", BIB)
    assert (b["title"], b["authors"], b["year"], b["doi"], b["type"]) == ("A Deep title", ["Lee, A", "Chen, B"], 2021, "10.1/q", "article")
    (t,) = read(spark, "a.csv", "题名;年份;Times Cited;AU\nX;2001年;12 times;A|B\n")
    assert (t["title"], t["year"], t["citations"], t["authors"]) == ("X", 2001, 12, ["A", "B"])
    rows = read(spark, "a.jsonl", '{"title": "a b", "authors": [{"name": "Lee"}, "Doe"], "publication_date": "2004/5/1"}\n\n{"title": "c", "year": 1999}\n')
    assert [(r["title"], r["year"], r["authors"], r["publication_date"]) for r in rows] == [("a b", 2004, ["Lee", "Doe"], "2004-05-01"), ("c", 1999, [], "")]


def test_workbook(spark):
    import io
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><t>Some work</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Year</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>2010</v></c></row></sheetData></worksheet>')
    (r,) = read(spark, "a.xlsx", out.getvalue())
    assert (r["title"], r["year"]) == ("Some work", 2010)


def test_files_and_errors(spark, tmp_path):
    (tmp_path / "a.ris").write_text(RIS)
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.CSV").write_text("title,year\nDeep one,2003\n")
    (tmp_path / "notes.pdf").write_text("not an export")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in P.read_exports(spark, str(tmp_path)).collect()}
    assert rows["a.ris"]["title"] == "A title" and rows["b.json"]["error"].startswith("JSONDecodeError") and rows["c.CSV"]["year"] == 2003 and len(rows) == 3


def test_index_works(spark):
    work = {"id": "https://x/W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "counts_by_year": [{"year": 2021, "cited_by_count": 2}], "referenced_works": ["https://x/W2"]}
    r = P.index_works(spark.createDataFrame([(json.dumps(work),)], "value string")).first()
    assert (r["openalex"], r["doi"], r["abstract"], r["references"], r["citation_counts_by_year"]) == ("W1", "10.1/a", "a b a", ["W2"], {"2021": 2})


def test_absent_csv_is_empty(spark, tmp_path):
    assert P.read_csv_or_empty(spark, str(tmp_path / "none.csv"), "a string").count() == 0
