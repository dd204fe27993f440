"""Where results go: a corpus in several formats, analysis tables, references, and drafts as web pages."""

from __future__ import annotations

import html
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.drafts import RECORD, SOURCE, clean_markers
from .operators.evidence import ris_escape, set_difference

MOST_SHOWN = 5_000


def flat_view(records: DataFrame) -> DataFrame:
    """Canonical records as one row of plain values each."""
    return records.select(
        "record_id", "title", F.array_join(F.col("authors")["name"], "; ").alias("authors"), "year", "venue", F.coalesce("ids.doi", F.lit("")).alias("doi"), "abstract", F.array_join("keywords", "; ").alias("keywords"),
        F.coalesce(F.array_max(F.map_values("citation_counts")), F.lit(0)).alias("citations"), (F.col("inclusion.status") if "inclusion" in records.columns else F.lit("candidate")).alias("inclusion"),
    )


def record_markdown(records: DataFrame) -> DataFrame:
    """(record_id, text): a section of Markdown for each record of ``flat_view``."""
    line = lambda name, c: F.concat(F.lit(f"- {name}: "), F.coalesce(F.col(c).cast("string"), F.lit("")))
    head = F.concat(F.lit("## ["), "record_id", F.lit("] "), F.coalesce("title", F.lit("")))
    return records.select("record_id", F.concat_ws("\n", head, F.lit(""), line("authors", "authors"), line("year", "year"), line("doi", "doi"), line("keywords", "keywords"), F.lit(""), F.coalesce("abstract", F.lit("")), F.lit("")).alias("text"))


def write_corpus(records: DataFrame, path: str) -> None:
    """Canonical records under ``path`` as Parquet and JSON lines, and their flat view as CSV and Markdown."""
    records.write.mode("overwrite").parquet(f"{path}/corpus.parquet")
    kept = records.sparkSession.read.parquet(f"{path}/corpus.parquet")
    kept.write.mode("overwrite").json(f"{path}/corpus.jsonl")
    view = flat_view(kept)
    view.write.mode("overwrite").option("header", "true").csv(f"{path}/records.csv")
    record_markdown(view).select("text").write.mode("overwrite").text(f"{path}/records.md")


def review_queue(merged: DataFrame, least: float = 0.98) -> DataFrame:
    """(kept_id, other_id, score): merges (record_id, audit) by title, year and author alone whose titles differ, for a person to look at."""
    a = merged.select(F.col("record_id").alias("kept_id"), F.explode("audit").alias("a"))
    return a.where((F.col("a.action") == "merged") & (F.col("a.method") == "title-year-author") & (F.col("a.score") < least)).select("kept_id", F.col("a.other_id").alias("other_id"), F.col("a.score").alias("score"))


def markdown_table(title: str, frame: DataFrame, most: int = MOST_SHOWN) -> str:
    """A table of at most ``most`` rows, with the number of all."""
    n, shown = frame.count(), frame.limit(most).toPandas()
    cell = lambda v: "" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else str(v).replace("|", "\\|").replace("\n", " ")
    rows = ["| " + " | ".join(map(cell, r)) + " |" for r in shown.itertuples(index=False)]
    body = "\n".join(["| " + " | ".join(shown.columns) + " |", "|" + "---|" * len(shown.columns), *rows]) if n else "_no data_"
    return f"# {title}\n\n- rows_total: {n}\n\n{body}\n"


def write_tables(tables: dict[str, DataFrame], path: str, most: int = MOST_SHOWN) -> None:
    """Each table under ``path`` as Parquet and CSV, whole, and as a Markdown preview of at most ``most`` rows."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{path}/parquet/{name}")
        spark = frame.sparkSession
        kept = spark.read.parquet(f"{path}/parquet/{name}")
        kept.write.mode("overwrite").option("header", "true").csv(f"{path}/tables/{name}")
        spark.createDataFrame([(markdown_table(name, kept, most),)], "text string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown/{name}")


def web_ris(source_id: Column, title: Column, name: Column, date: Column, url: Column, retrieved: Column) -> Column:
    """A web source in RIS."""
    tag = lambda t, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{t}  - "), ris_escape(c)))
    return F.concat_ws("\n", F.lit("TY  - ELEC"), tag("ID", source_id), tag("TI", title), tag("AU", name), tag("PY", F.substring(date, 1, 4)), tag("Y1", date), tag("UR", url), tag("Y2", retrieved), F.lit("ER  -"))


# drafts as web pages

_SPANS = ((r"\*\*(.+?)\*\*", r"<strong>\1</strong>"), (r"\*(.+?)\*", r"<em>\1</em>"), (r"`([^`]+)`", r"<code>\1</code>"), (r"\[([^]]+)\]\(([^)]+)\)", r'<a href="\2">\1</a>'))
_BLOCKS = (("heading", re.compile(r"(#{1,6})\s+(.+)")), ("bullet", re.compile(r"[-*+]\s+(.*)")), ("number", re.compile(r"\d+[.)]\s+(.*)")), ("quote", re.compile(r">[> ]*(.*)")))


def spans(text: str) -> str:
    """Escaped text with bold, italic, code and links."""
    text = html.escape(text)
    for pattern, new in _SPANS:
        text = re.sub(pattern, new, text)
    return text


def blocks(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, level) of the blocks of a Markdown text: headings, list items, quotes, code and paragraphs."""
    out: list[tuple[str, str, int]] = []
    prose: list[str] = []
    code: list[str] | None = None

    def close() -> None:
        if prose:
            out.append(("prose", " ".join(prose), 0))
            prose.clear()

    for line in map(str.rstrip, text.splitlines()):
        if line.startswith("```"):
            close()
            if code is not None:
                out.append(("code", "\n".join(code), 0))
            code = [] if code is None else None
        elif code is not None:
            code.append(line)
        elif hit := next(((kind, m) for kind, p in _BLOCKS if (m := p.fullmatch(line))), None):
            close()
            kind, m = hit
            out.append((kind, m[m.lastindex].strip(), len(m[1]) if kind == "heading" else 0))
        elif line:
            prose.append(line)
        else:
            close()
    close()
    return out


def page_body(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(HTML, [(anchor, title)] of its headings) of a Markdown text."""
    shapes = {"bullet": "<ul><li>{}</li></ul>", "number": "<ol><li>{}</li></ol>", "quote": "<blockquote>{}</blockquote>", "prose": "<p>{}</p>"}
    out, contents = [], []
    for kind, t, level in blocks(text):
        if kind == "heading":
            contents.append((f"h{len(contents) + 1}", t))
            out.append(f'<h{level} id="{contents[-1][0]}">{spans(t)}</h{level}>')
        else:
            out.append(f"<pre><code>{html.escape(t)}</code></pre>" if kind == "code" else shapes[kind].format(spans(t)))
    return "\n".join(out), contents


def page(title: str, text: str) -> str:
    """A web page of a Markdown text with its contents, which prints on A4."""
    body, contents = page_body(text)
    links = "".join(f'<a href="#{a}">{html.escape(t)}</a>' for a, t in contents)
    style = "@page{size:A4;margin:25mm}body{max-width:46em;margin:auto;font-family:serif;line-height:1.7}nav a{display:block}@media print{nav{display:none}}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><nav>{links}</nav><article>{body}</article></body></html>'


def pages(drafts: DataFrame, title: str, text: str) -> DataFrame:
    """``drafts`` with ``html``: each draft, its marks taken out, as a web page."""

    @F.pandas_udf("string")
    def run(titles: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([page(t or "", x or "") for t, x in zip(titles, texts, strict=True)])

    return drafts.withColumn("html", run(F.col(title), clean_markers(F.col(text))))


def table_page(title: str, frame: DataFrame, most: int = MOST_SHOWN) -> str:
    """A web page of a table of at most ``most`` rows."""
    shown = frame.limit(most).toPandas()
    row = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    body = "".join(row("td", r) for r in shown.itertuples(index=False))
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{row("th", shown.columns)}{body}</table></body></html>'


def export_problems(drafts: DataFrame, key: str, text: str, approvals: DataFrame, ris: DataFrame, punctuation: dict[str, str], introduction: bool = False) -> DataFrame:
    """(key, problem): what keeps drafts from being delivered.

    A draft must be approved and validated as it stands: ``approvals`` (key, approved_sha256, validated_sha256). Without its
    marks it must have no defects, and the ids in ``ris`` (key, ris: the references as RIS) must be just those that it cites.
    """
    from .functions.records import content_hash
    from .operators.drafts import body, delivery_defects, ids_in

    d = drafts.select(key, text, content_hash(F.col(text)).alias("_sha")).join(approvals, key, "left")
    stale = lambda c: ~F.coalesce(F.col(c) == F.col("_sha"), F.lit(False))
    found = d.select(key, F.explode(F.array_compact(F.array(F.when(stale("approved_sha256"), F.lit("not-approved-as-it-stands")), F.when(stale("validated_sha256"), F.lit("not-validated-as-it-stands"))))).alias("problem"))
    found = found.unionByName(delivery_defects(drafts, key, text, introduction, punctuation).withColumnRenamed("defect", "problem"))
    pair = lambda df, c: df.select(F.col(key).alias("key"), F.explode(c).alias("cited")).select(F.to_json(F.struct("key", "cited")).alias("id"))
    cited = pair(drafts, ids_in(body(F.col(text)), f"{RECORD}|{SOURCE}"))
    listed = pair(ris, F.array_distinct(F.regexp_extract_all("ris", F.lit(rf"(?m)^ID  - ({RECORD}|{SOURCE})$"), F.lit(1))))
    kind = drafts.schema[key].dataType.simpleString()
    differ = set_difference(cited, listed).select(F.from_json("id", f"key {kind}, cited string")["key"].alias(key)).distinct()
    return found.unionByName(differ.select(key, F.lit("references-differ-from-citations").alias("problem"))).distinct()


def pack_library(cards: DataFrame, path: str) -> int:
    """Cards as one JSON file each in a zip at a local ``path``; their number. A library of cards is small."""
    rows = cards.select("theory_id", F.to_json(F.struct(*cards.columns)).alias("card")).toLocalIterator()
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for r in rows:
            z.writestr(f"cards/{r['theory_id']}.json", r["card"])
            n += 1
    return n


def unpack_library(spark: SparkSession, path: str, schema) -> tuple[DataFrame, list[str]]:
    """(cards, names not taken) of such a zip: only files cards/<id>.json are read, and none is written anywhere."""
    with zipfile.ZipFile(path) as z:
        good = [i.filename for i in z.infolist() if re.fullmatch(r"cards/[A-Za-z0-9_-]+\.json", i.filename)]
        bad = sorted({i.filename for i in z.infolist() if not i.is_dir()} - set(good))
        rows = [(z.read(n).decode("utf-8"),) for n in good]
    text = spark.createDataFrame(rows, "card string")
    return text.select(F.from_json("card", schema).alias("c")).select("c.*"), bad
