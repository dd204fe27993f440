"""Secret scans with one combined deterministic automaton.

All rules are compiled by subset construction and minimisation into one table of transitions that is
read once over every byte of every text. Bytes that lead back to the start from any state part the texts into
pieces that cannot share a match, so that thousands of pieces advance in step, one byte each at a time.
Pieces in which the automaton accepts are then read by each rule's own automaton, which gives
the leftmost, longest, non-overlapping matches; those too short for their rule are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Dfa, compile_dfa, longest, search_lanes, spans
from .common import named, portions, unused

_VALUE = r"[A-Za-z0-9+/_.=\-]"
_HEAD = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
#: kind → (what the rule matches, any case, what the combined automaton looks for, least length).
#: The combined automaton looks for the start of a match; each counted character more would multiply its states.
RULES = {
    "assign": (f"{_HEAD}{_VALUE}+", True, f"{_HEAD}{_VALUE}{{6,}}", 0),
    "access": ("AKIA[A-Z0-9]+", False, "AKIA[A-Z0-9]{6,}", 20),
    "hex": ("[0-9a-f]+", False, "[0-9a-f]{16,}", 24),
    "github": ("gh[opsur]_[A-Za-z0-9]+", False, "gh[opsur]_[A-Za-z0-9]{4,}", 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9\-]+", False, r"xox[abprs]-[A-Za-z0-9\-]{4,}", 15),
    "google": (r"AIza[A-Za-z0-9_\-]+", False, r"AIza[A-Za-z0-9_\-]{4,}", 39),
    "pem": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", False, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "github_pat": ("github_pat_[A-Za-z0-9_]+", False, "github_pat_[A-Za-z0-9_]{2,}", 33),
    "gitlab": (r"glpat-[A-Za-z0-9_\-]+", False, r"glpat-[A-Za-z0-9_\-]{2,}", 26),
    "npm": ("npm_[A-Za-z0-9]+", False, "npm_[A-Za-z0-9]{4,}", 40),
    "stripe": ("[spr]k_(live|test)_[A-Za-z0-9]+", False, "[spr]k_(live|test)_[A-Za-z0-9]{2,}", 24),
    "sendgrid": (r"SG\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, r"SG\.[A-Za-z0-9_\-]{4,}", 40),
    "jwt": (r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", False, r"eyJ[A-Za-z0-9_\-]{4,}", 40),
    "url": (r"://[A-Za-z0-9._\-]+:[A-Za-z0-9._+\-]+@", False, r"://[A-Za-z0-9._\-]+:[A-Za-z0-9._+\-]+@", 12),
}
#: A private key from its first line on: up to its last line, or without one as far as long lines of base 64 follow.
_BODY = r"[A-Za-z0-9+/=:,.\\\x20\x09\x0A\x0D]"
_PEM = RULES["pem"][0]
_KEY = rf"{_PEM}(({_BODY}|-{_BODY})*-----END [A-Z ]*PRIVATE KEY-----|(\x0D?\x0A[A-Za-z0-9+/=]{{32,}})*)"
KINDS = list(RULES)
BASE = ("assign", "access", "hex")
LEAST = 12
VALUE_LEAST = 6
_HEAD_RE = re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?")


@functools.cache
def automata() -> tuple[Dfa, dict[str, Dfa], Dfa]:
    """The combined automaton, one for each rule, and that of a whole private key."""
    both = compile_dfa([(r[2], r[1]) for r in RULES.values()], True)
    return both, {k: compile_dfa([(r[0], r[1])], False) for k, r in RULES.items()}, compile_dfa([(_KEY, False)], False)


def scan(texts: list[str | None], tables: tuple[Dfa, dict[str, Dfa], Dfa] | None = None) -> list[list[tuple[int, int, str]]]:
    """Per text its secrets as (start, end, kind), in code points, by start and then by kind as listed."""
    both, single, key = tables or automata()
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    out: list[list[tuple[int, int, str]]] = [[] for _ in raw]
    joined = b"\n".join(raw)
    buffer = np.frombuffer(joined, np.uint8)
    breaks = np.flatnonzero(both.resets()[buffer])
    starts = np.concatenate([[0], breaks + 1])
    lengths = np.concatenate([breaks, [len(buffer)]]) - starts
    long = lengths >= LEAST
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return out
    hit = search_lanes(both, buffer, starts, lengths)
    first = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    for s, n in zip(starts[hit].tolist(), lengths[hit].tolist(), strict=True):
        d = int(np.searchsorted(first, s, "right")) - 1
        piece, at = joined[s : s + n], s - int(first[d])
        chars = len(raw[d][:at].decode("utf-8", "surrogatepass"))
        for kind, dfa in single.items():
            for a, b in spans(dfa, piece):
                size = b - a if kind != "assign" else b - a - _HEAD_RE.match(piece, a).end() + a
                if size >= (VALUE_LEAST if kind == "assign" else RULES[kind][3]):
                    if kind == "pem":  # the lines after it are beyond the piece
                        b = a + longest(key, raw[d], at + a)
                    out[d].append((chars + a, chars + b, kind))
    for o in out:
        o.sort(key=lambda x: (x[0], KINDS.index(x[2])))
    return out


def joined_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text counts as empty: no spans, and the digest of the empty string. Rows that share an id are scanned each for
    itself. Texts of any length are read whole. Further columns are not read. An empty table gives an empty result.
    Spans of different kinds may overlap; of one kind they do not.
    """

    tables = automata()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in portions(batches):
            rows = []
            for doc_id, found in zip(pdf["doc_id"].array, scan([t if isinstance(t, str) else None for t in pdf["text"]], tables), strict=True):
                base = [x for x in found if x[2] in BASE]
                rows.append((doc_id, *(sum(x[2] == k for x in base) for k in BASE), hashlib.sha256(joined_spans(base).encode()).hexdigest(), joined_spans(found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each group of overlapping spans replaced by the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(found):
        a, b, kind = found[i]
        while i + 1 < len(found) and found[i + 1][0] < b:
            i += 1
            b = max(b, found[i][1])
        out += [text[at:a], f"[{kind}]"]
        at, i = b, i + 1
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """``docs`` with every secret masked and, where there is such a column, the number of code points of changed texts set anew.

    Every row and column stays, whatever the columns' names; rows without secrets, null and empty texts are unchanged.
    Overlapping spans are replaced together, by the kind of the one that starts first. Rows that share an id are
    masked each for itself. An empty table gives an empty result.
    """
    tables = automata()

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        own = [t if isinstance(t, str) else None for t in texts]
        return pd.Series([mask(t, f) if f else t for t, f in zip(own, scan(own, tables), strict=True)], dtype=object)

    own = unused(docs.columns, "_masked")
    put = {text: named(own)}
    if length in docs.columns:
        put[length] = F.when(named(own) != named(text), F.char_length(named(own)).cast(docs.schema[length].dataType)).otherwise(named(length))
    return docs.withColumn(own, masked(named(text))).select(*[put.get(c, named(c)).alias(c) for c in docs.columns])
