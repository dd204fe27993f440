"""Theory cards from pages and their histories; references and enrichment on cases by hand; medians from counts."""

import random
import statistics

from pyspark.sql import functions as F

from litweave.operators import evidence, theories, topics
from litweave.sources import parsers


def plain_history(events):
    """(states, illegal steps) by going through each card's events one by one."""
    states, wrong = {}, set()
    for card, at, action in sorted(set(events), key=lambda e: (e[0], e[1])):
        state = states.get(card)
        if action not in theories.ACTIONS:
            wrong.add(("unknown-action", card, at))
        elif action == "ingest":
            states.setdefault(card, "candidate")
        elif state is None:
            wrong.add(("theory-not-found", card, at))
        elif action == "confirm" and state != "source-located":
            wrong.add(("not-source-located", card, at))
        elif action == "disable" or state == "disabled":
            states[card] = "disabled"
        elif action == "complete" and state == "candidate":
            states[card] = "source-located"
        elif action == "confirm":
            states[card] = "content-verified"
    return states, wrong


def test_histories_in_any_order(spark):
    rng = random.Random(4)
    weights = {"ingest": 4, "complete": 4, "confirm": 4, "disable": 1, "update": 2, "odd": 1}
    events = [(f"T{rng.randrange(60)}", at, rng.choices(list(weights), weights.values())[0]) for at in range(400)]
    states, wrong = plain_history(events)
    assert set(states.values()) == {"candidate", "source-located", "content-verified", "disabled"} and {w[0] for w in wrong} == {"unknown-action", "theory-not-found", "not-source-located"}
    for seed in (1, 2):
        mixed = events + events[:50]
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame([*mixed, (None, 3, "ingest"), ("T1", None, "disable")], "theory_id string, at long, action string")
        assert {r["theory_id"]: r["verification_status"] for r in theories.card_states(df).collect()} == states
        legal = df.where("theory_id is not null and at is not null")
        assert sorted(tuple(r) for r in theories.illegal_steps(legal).collect()) == sorted(wrong)
    assert theories.card_states(df.limit(0)).count() == 0 and theories.illegal_steps(df.limit(0)).count() == 0


def test_pages_as_cards(spark):
    page = lambda title, body: f"<html><head><title>{title}</title><style>p {{}}</style></head><body><p>{body}</p></body></html>"
    rows = [
        ("https://x.org/b/index.html", page("Social exchange theory - a site", "People  trade."), 1), ("https://x.org/a/Social exchange theory/index.html?v=1", page("t", "Earlier"), 2), ("https://x.org/a/Social exchange theory/index.html?v=1", page("t", "Earlier"), 3),
        ("https://x.org/自我决定理论.html", None, 4), (None, page("", ""), 5),
    ]
    cards = theories.ingest_pages(spark.createDataFrame(rows, "url string, html string, theory_id long"))
    got = {r["name_en"] or r["name_zh"]: r for r in cards.collect()}
    assert set(got) == {"Social exchange theory", "自我决定理论", "Unnamed theory candidate"}
    one = got["Social exchange theory"]
    assert one["source_files"] == [rows[1][0], rows[0][0]] and len(one["source_hashes"]) == 2 and one["source_excerpt"].endswith("Earlier") and one["verification_status"] == "candidate"
    assert got["自我决定理论"]["name_zh"] and not got["自我决定理论"]["name_en"]
    more = spark.createDataFrame([(one["theory_id"], ["u"], "other"), ("T0", ["v"], "x")], "theory_id string, source_files array<string>, name_en string")
    revised, lost = theories.revise_cards(cards, more, ["source_files"], ["name_en"])
    new = {r["theory_id"]: r for r in revised.collect()}
    assert new[one["theory_id"]]["source_files"] == [*one["source_files"], "u"] and new[one["theory_id"]]["name_en"] == "Social exchange theory" and len(new) == 3
    assert [tuple(r) for r in lost.collect()] == [("theory-not-found", "T0")]


def test_references(spark):
    def apa(authors, year=2020, title="A title.", venue="V", doi=None, volume=None, issue=None, pages=None):
        row = spark.createDataFrame([(authors, year, title, venue, doi, volume, issue, pages)], "a array<string>, y int, t string, v string, d string, vo string, i string, p string")
        return row.select(evidence.apa(*map(F.col, "aytvd"), F.col("vo"), F.col("i"), F.col("p")).alias("x")).first()["x"]

    assert apa(["Smith, John", "smith john", "Smith, J.", "Lee, A.", " ", None]) == "Smith, John, & Lee, A. (2020). A title. V."
    assert apa(["John Smith", "J Smith", "Jane Smith"]) == "John Smith. (2020). A title. V."
    assert apa(None, None, None, None) == "Unknown author. (n.d.). Untitled." and apa([], 0, "T。", "", "https://doi.org/10.1/x") == "Unknown author. (n.d.). T. https://doi.org/10.1/x"
    assert apa(["李明"], venue="V.", volume="3", issue="2", pages="1-9") == "李明. (2020). A title. V, 3(2), 1-9." and apa(["李明"], venue="", volume="3") == "李明. (2020). A title."
    many = [f"N{i}, Ab{i}cdefgh" for i in range(25)]
    assert apa(many[:20]).startswith(", ".join(many[:19]) + ", & " + many[19] + ".") and apa(many).startswith(", ".join(many[:19]) + ", …, " + many[24] + ".")
    item = spark.createDataFrame([(["Lee, A B", "Ann Bo Chu", "Plato", ""],)], "a array<string>").select(evidence.csl(F.lit("r"), F.lit(None), F.col("a"), F.lit(None).cast("int"), F.lit("V"), F.lit("10.1/x"), F.lit("book"), ISBN=F.lit("9")).alias("x")).first()["x"]
    assert item == '{"id":"r","type":"book","title":"","author":[{"family":"Lee","given":"A B"},{"family":"Chu","given":"Ann Bo"},{"family":"Plato","given":""}],"issued":{},"container-title":"V","volume":"","issue":"","page":"","publisher":"","DOI":"10.1/x","ISSN":"","ISBN":"9"}'


def test_answers_of_services(spark):
    records = spark.createDataFrame([("a", ("10.1/X", None), None, None, None), ("b", (None, "k"), "own", {"semantic_scholar": 3}, [("f", "t")])], "record_id string, ids struct<doi:string,s2:string>, abstract string, citation_counts map<string,bigint>, provenance array<struct<source:string,retrieved_at:string>>")
    s2 = spark.createDataFrame([("https://doi.org/10.1/x", "P1", "text", None), ("", "P2", "no", 7)], "doi string, paperId string, abstract string, citationCount long")
    a, b = parsers.semantic_scholar(records, s2, "now").orderBy("record_id").collect()
    assert (a["ids"]["s2"], a["abstract"], a["citation_counts"], [p["source"] for p in a["provenance"]]) == ("P1", "text", {"semantic_scholar": 0}, ["semantic_scholar"])
    assert (b["ids"]["s2"], b["abstract"], b["citation_counts"], len(b["provenance"])) == ("k", "own", {"semantic_scholar": 3}, 1)
    oa = spark.createDataFrame([("10.1/x", None, "gold", None)], "doi string, is_oa boolean, oa_status string, best_oa_location struct<license:string,url_for_landing_page:string,url_for_pdf:string>")
    a, b = parsers.open_access(records, oa, "now").orderBy("record_id").collect()
    assert (a["oa"]["is_oa"], a["oa"]["status"], a["oa"]["pdf_url"]) == (False, "gold", None) and b["oa"] is None and len(b["provenance"]) == 1


def test_medians_from_counts(spark):
    """Even and odd sizes, ties, one group of nearly all rows."""
    rng = random.Random(3)
    values = [(g, rng.randrange(40) if g else rng.randrange(3)) for g in (0, 1, 2, 3) for _ in range((1, 2, 7, 400)[g])]
    counts = spark.createDataFrame(values, "g long, v long").groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r["g"]: r["median"] for r in topics.medians(counts, ["g"], "v").collect()}
    assert got == {g: statistics.median([v for h, v in values if h == g]) for g in (0, 1, 2, 3)}
