"""Column functions over strings and lists of a record. All are built-in expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"一-鿿"
DOI = r"(?i)10\.\d{4,9}/[-._;()/:A-Z0-9]+"
#: Words that carry no topic (fixed values).
STOP = (
    "the", "and", "of", "in", "to", "a", "for", "on", "with", "by", "an", "from", "using", "based",
    "study", "research", "analysis", "results", "effect", "effects", "impact", "examining", "role",
    "与", "及", "的", "在", "基于", "研究", "分析", "影响", "作用", "结果",
)
#: Spellings that are one term (fixed values).
VARIANTS = (("ecommerce", "e-commerce"), ("e commerce", "e-commerce"), ("livestreaming", "live-streaming"), ("live streaming", "live-streaming"), ("information overloads", "information overload"), ("purchase intentions", "purchase intention"))


def present(c: Column) -> Column:
    """Whether a string, list or map holds anything."""
    return F.coalesce(c.isNotNull() & (c.cast("string") != ""), F.lit(False))


def normalize_doi(c: Column) -> Column:
    """Lower case, without resolver or ``doi:`` before it and punctuation after it."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""), r"[. ,;)]+$", "")


def normalize_title(c: Column) -> Column:
    """Only lower-case letters a-z, digits and CJK characters; tags are dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"<[^>]+>", " "), rf"[^0-9a-z{CJK}]+", "")


def as_list(c: Column) -> Column:
    """Parts between semicolons or bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"[;|]"), lambda x: F.trim(x)), lambda x: x != "")


def record_id(doi: Column, openalex: Column, pmid: Column, title: Column, year: Column, author: Column) -> Column:
    """R and 14 hex digits of the SHA-1 of the first identity that is there."""
    some = lambda c: F.when(c != "", c)
    seed = F.coalesce(
        some(normalize_doi(doi)), some(F.regexp_extract(openalex, r"([^/]*)$", 1)), some(pmid),
        F.concat_ws(":", F.coalesce(normalize_title(title), F.lit("")), F.coalesce(year.cast("string"), F.lit("")), F.coalesce(normalize_title(author), F.lit(""))),
    )
    return F.concat(F.lit("R"), F.substring(F.sha1(seed), 1, 14))


def reference_key(raw: Column) -> Column:
    """DOI, else OpenAlex number, else the first 180 characters of the normalised text; null if there is none."""
    doi, oa, title = F.regexp_extract(raw, DOI, 0), F.regexp_extract(raw, r"W\d+", 0), F.substring(normalize_title(raw), 1, 180)
    return F.when(doi != "", F.concat(F.lit("doi:"), normalize_doi(doi))).when(oa != "", F.concat(F.lit("openalex:"), oa)).when(title != "", F.concat(F.lit("raw:"), title))


def most_cited(counts: Column) -> Column:
    """The largest count of any source; sources are never added up."""
    return F.coalesce(F.array_max(F.transform(F.map_values(counts), lambda v: v.try_cast("double").cast("long"))), F.lit(0)).cast("long")


def keyword_list(keywords: Column, machine: Column) -> Column:
    """Distinct lower-case keywords in their order, without those a machine gave."""
    tidy = lambda a: F.transform(a, lambda k: F.regexp_replace(F.lower(F.trim(k)), r"\s+", " "))
    return F.filter(F.array_except(F.array_distinct(tidy(keywords)), F.coalesce(tidy(machine), F.array().cast("array<string>"))), lambda k: k != "")


def modeling_text(title: Column, abstract: Column) -> Column:
    """The title twice, then the abstract, in single spaces."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return F.trim(F.regexp_replace(F.concat_ws(" ", t, t, a), r"\s+", " "))


def language_class(c: Column) -> Column:
    """zh, en, mixed or unknown, by the letters that occur."""
    zh, en = c.rlike(f"[{CJK}]"), c.rlike("[A-Za-z]")
    return F.when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise("unknown")


def normalize_ascii(c: Column) -> Column:
    """Lower case, plain dashes, one spelling, single spaces; for text in ASCII the same as with compatibility folding."""
    out = F.regexp_replace(F.lower(c), r"[‐-―]", "-")

    def one_spelling(t: Column) -> Column:
        same = t
        for a, b in VARIANTS:
            same = F.regexp_replace(same, rf"\b{a}\b", b)
        # a text without any of the variants stays as it is, and most have none
        return F.when(reduce(Column.__or__, [F.contains(t, F.lit(a)) for a, _ in VARIANTS]), same).otherwise(t)

    out = F.get(F.transform(F.array(out), one_spelling), F.lit(0))
    return F.trim(F.regexp_replace(out, r" \s+|[^\S ]\s*", " "))


def normalize_text(c: Column) -> Column:
    """``normalize_ascii`` after compatibility folding of characters and case, which only texts beyond ASCII need."""

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")

    return normalize_ascii(F.when(c.rlike(r"[^\x00-\x7F]"), folded(c)).otherwise(c))


def strip_markup(c: Column) -> Column:
    """A text without tags, its entities resolved, with single spaces."""
    return F.trim(F.regexp_replace(unescaped(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", " ")), r"\s+", " "))


def language_tokens(c: Column) -> Column:
    """Latin words of two letters or more and pairs of neighbouring CJK characters, without stop words."""
    # a chunk is of one kind, and only those of letters begin with a to z
    chunks = F.regexp_extract_all(normalize_ascii(c), F.lit(rf"[a-z][a-z0-9-]+|[{CJK}]+"), F.lit(0))
    pairs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
    parts = F.flatten(F.transform(chunks, lambda w: F.when(w >= "{", pairs(w)).otherwise(F.array(w))))
    return F.filter(parts, lambda w: ~w.isin(*STOP) & (F.char_length(w) > 1))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` tokens, joined by a space."""

    def of(n: int) -> Column:
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))

    return F.flatten(F.array(*[of(n) for n in range(low, high + 1)]))


def reference_year(c: Column) -> Column:
    """The first year from 1800 to 2099 that is no part of a longer number."""
    return F.regexp_extract(c, r"(?<!\d)((?:18|19|20)\d{2})(?!\d)", 1).try_cast("int")


def claim_ids(c: Column) -> Column:
    """Claims named in a text, ranges such as C0001-C0005 written out (at most 100 of one)."""
    found = F.regexp_extract_all(c, F.lit(r"C(\d{4})(?:\s*[-–—]\s*C(\d{4}))?"), F.lit(0))

    def run(x: Column) -> Column:
        a = F.regexp_extract(x, r"C(\d{4})", 1).cast("int")
        b = F.coalesce(F.regexp_extract(x, r"C\d{4}\s*[-–—]\s*C(\d{4})", 1).try_cast("int"), a)
        return F.when((b >= a) & (b - a <= 100), F.transform(F.sequence(a, F.greatest(a, b)), lambda i: F.concat(F.lit("C"), F.lpad(i.cast("string"), 4, "0")))).otherwise(F.array(F.concat(F.lit("C"), F.lpad(a.cast("string"), 4, "0"))))

    return F.array_distinct(F.flatten(F.transform(found, run)))


def sentences(c: Column) -> Column:
    """Sentences of a paragraph; they end at full-width stops and at ! and ?, not at an ASCII full stop."""
    return F.filter(F.transform(F.split(c, r"(?<=[。！？!?])\s*"), lambda s: F.trim(s)), lambda s: s != "")


def alignment_terms(c: Column) -> Column:
    """Latin words of four letters or more and CJK runs of two to four characters, without stop words."""
    latin = F.regexp_extract_all(F.lower(c), F.lit(r"[a-z]{4,}"), F.lit(0))
    cjk = F.regexp_extract_all(c, F.lit(f"[{CJK}]+"), F.lit(0))
    grams = lambda w, n: F.when(F.char_length(w) >= n, F.transform(F.sequence(F.lit(1), F.char_length(w) - n + 1), lambda i: F.substring(w, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(latin, F.flatten(F.transform(cjk, lambda w: F.concat(grams(w, 2), grams(w, 3), grams(w, 4)))))), lambda w: ~w.isin(*STOP))


def abstract_from_index(index: Column) -> Column:
    """The text of an inverted index (word → positions)."""
    spots = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(spots), lambda s: s["w"]), " ")


def unescaped(c: Column) -> Column:
    """A text with its named and numbered entities resolved, once: ``&amp;lt;`` is ``&lt;``."""
    names = {f"&{n};": chr(code) for n, code in name2codepoint.items() if n != "amp"}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    found = lambda pattern: F.array_distinct(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)))
    out = F.aggregate(found("(&[A-Za-z]+[0-9]*;)"), c, lambda text, e: F.replace(text, e, F.coalesce(F.try_element_at(table, e), e)))

    def number(e: Column) -> Column:
        digits = F.regexp_extract(e, "&#[xX]?([0-9A-Fa-f]+);", 1)
        code = F.when(e.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
        return F.when((code > 0) & (code < 0x110000), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(e)

    out = F.aggregate(found("(&#(?:[xX][0-9A-Fa-f]+|[0-9]+);)"), out, lambda text, e: F.replace(text, e, number(e)))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def html_text(c: Column) -> Column:
    """Text of a page: scripts, styles and drawings dropped, blocks on lines of their own, entities resolved."""
    out = F.regexp_replace(c, r"(?is)<(script|style|svg|noscript)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:/?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|section|article|nav|header|footer|title))\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.replace(unescaped(out), F.lit("\xa0"), F.lit(" "))
    lines = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r"\s*\n\s*", "\n")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1))


def wos_query(groups: Column, exclude: Column) -> Column:
    """Topic query: phrases quoted, terms of a group joined by OR, groups by AND, exclusions by NOT."""
    quoted = lambda t: F.when(t.rlike(r"\s|-"), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"'))).otherwise(t)
    group = F.transform(groups, lambda g: F.concat(F.lit("TS=("), F.array_join(F.transform(g, quoted), " OR "), F.lit(")")))
    out = F.when(F.size(exclude) > 0, F.concat(F.lit(" NOT TS=("), F.array_join(F.transform(exclude, quoted), " OR "), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(group, " AND "), out)
