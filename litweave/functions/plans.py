"""Checks of the plans that a search and a focus start from. Plans are small documents, read on the driver."""

from __future__ import annotations

import re

CJK, LATIN = re.compile("[一-鿿]"), re.compile("[A-Za-z]")


def language_of(text) -> str:
    """zh, en, mixed or unknown, by the letters that a text has."""
    has = bool(CJK.search(str(text or ""))), bool(LATIN.search(str(text or "")))
    return {(True, True): "mixed", (True, False): "zh", (False, True): "en"}.get(has, "unknown")


def check_focus_plan(plan: dict) -> dict:
    """valid, errors and warnings of a plan of concept groups."""
    groups = [g for g in plan.get("core_groups") or [] if g.get("id") and any(str(t).strip() for t in g.get("terms") or [])]
    required = [g for g in groups if g.get("required")]
    least, other = int(plan.get("minimum_core_groups") or 1), plan.get("unmatched_action", "needs-review")
    errors = {
        "not-approved": not plan.get("approved") or plan.get("status") not in ("approved", "validated"),
        "no-usable-group": not groups,
        "minimum-out-of-range": not 1 <= least <= len(groups),
        "unknown-unmatched-action": other not in ("needs-review", "excluded"),
    }
    warnings = {"no-required-group": not required, "unmatched-records-are-excluded": other == "excluded"}
    found = [k for k, bad in errors.items() if bad]
    return {"valid": not found, "errors": found, "warnings": [k for k, bad in warnings.items() if bad], "usable_core_groups": len(groups), "required_core_groups": len(required)}


def check_search_plan(plan: dict) -> dict:
    """valid, errors, warnings and queries of a search plan; one that starts from Chinese needs both languages throughout."""
    queries = []
    for i, q in enumerate(plan.get("queries") or [], 1):
        q = {"id": f"Q{i:02d}", "family": "core", "query": q} if isinstance(q, str) else dict(q)
        queries.append(q | {"detected_language": language_of(q.get("query"))})
    said = lambda q: str(q.get("language") or "").lower()
    allowed = {"en": ("en", "mixed"), "zh": ("zh", "mixed"), "zh-cn": ("zh", "mixed")}
    errors = ["no-queries"] if not queries else []
    errors += [f"language-differs:{q.get('id')}" for q in queries if said(q) in allowed and q["detected_language"] not in allowed[said(q)]]
    source = str(plan.get("source_language") or language_of(plan.get("title_or_idea")))
    chinese, warnings = bool(CJK.search(str(plan.get("title_or_idea") or ""))) or source in ("zh", "mixed", "zh-CN"), []
    if chinese:
        concepts = [c for c in plan.get("concepts") or [] if isinstance(c, dict)]
        any_of = lambda c, key, p: any(p.search(str(t)) for t in c.get(key) or [])
        core = [q for q in queries if str(q.get("family") or "core").lower() == "core"]
        needs = {
            "title-zh-missing": CJK.search(str(plan.get("title_zh") or "")),
            "title-en-missing": language_of(plan.get("title_en")) == "en",
            "translation-not-completed": plan.get("translation_status") == "completed",
            "no-bilingual-concept": any(any_of(c, "zh", CJK) and any_of(c, "en", LATIN) for c in concepts),
            "no-chinese-core-query": any(q["detected_language"] in ("zh", "mixed") and said(q) in ("zh", "zh-cn") for q in core),
            "no-english-core-query": any(q["detected_language"] == "en" and said(q) == "en" for q in core),
        }
        errors += [k for k, ok in needs.items() if not ok]
        warnings = [f"concept-in-one-language:{c.get('name') or i}" for i, c in enumerate(concepts, 1) if not c.get("zh") or not c.get("en")]
    return {"valid": not errors, "errors": errors, "warnings": warnings, "source_language": source, "chinese_origin": chinese, "queries": queries}
