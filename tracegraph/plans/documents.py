"""Nested result documents of the verbs, and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from . import verbs


def _definitions(tables: dict[str, DataFrame], symbol: str, *kinds: str) -> list[dict]:
    return [{"qname": r.qname, "kind": r.kind, "file": r.file, "line": r.line_start, "signature": r.signature} for r in verbs.candidates(tables["nodes"], symbol, *kinds).collect()]


def _item(r) -> dict:
    return {"qname": r.qname, "site": r.site, "sites": r.sites, "origins": r.origins.split(","), "confidence": r.confidence, "tags": r.tags}


def sectioned(tables: dict[str, DataFrame], verb: str, symbol: str, least: float = schema.MIN_CONFIDENCE, limit: int = schema.LIST_LIMIT) -> dict:
    """Of ``callers`` and ``callees``."""
    found, end = _definitions(tables, symbol, "function", "macro"), "dst" if verb == "callers" else "src"
    rows = verbs.neighbours(verbs.pairs_of(tables, end), tables["nodes"], symbol, end, least, limit).orderBy("definition", "qname", "kind").collect() if found else []
    for d in found:
        own = [r for r in rows if r.definition == d["qname"]]
        d |= {"items": [_item(r) for r in own], "total": own[0].total if own else 0, "truncated": bool(own and own[0].truncated)}
    return {"verb": verb, "symbol": symbol, "min_conf": least, "definitions": found}


def explore(tables: dict[str, DataFrame], symbol: str, least: float = schema.MIN_CONFIDENCE, limit: int = schema.LIST_LIMIT) -> dict:
    found = _definitions(tables, symbol, "function")
    rows = verbs.explore(tables, symbol, least, limit).orderBy("section", "definition", "qname", "detail", "site").collect() if found else []
    for d in found:
        for section in ("callers", "callees", "globals"):
            own = [r for r in rows if r.definition == d["qname"] and r.section == section]
            d |= {section: [{"qname": r.qname, "access" if section == "globals" else "kind": r.detail, "site": r.site} for r in own], f"{section}_total": own[0].total if own else 0, f"{section}_truncated": bool(own and own[0].truncated)}
    return {"verb": "explore", "symbol": symbol, "min_conf": least, "definitions": found}


def impact(tables: dict[str, DataFrame], symbol: str, depth: int = 2, least: float = schema.MIN_CONFIDENCE, ambiguous: bool = False) -> dict:
    rows = verbs.impact(tables["edges"], tables["nodes"], symbol, depth, least, ambiguous).orderBy("definition", "depth", "qname").collect()
    out = []
    for d in _definitions(tables, symbol, "function"):
        own = [r for r in rows if r.definition == d["qname"]]
        depths: dict[str, list] = {}
        files: dict[str, list] = {}
        for r in own:
            depths.setdefault(str(r.depth), []).append(r.qname)
            files.setdefault(r.file, []).append({"name": r.qname, "line": r.line})
        hint = None if own or ambiguous else verbs.impact_hint(tables["edges"], d["qname"]) or None
        out.append({"qname": d["qname"], "affects": len(own), "depths": depths, "by_file": files, "hint": f"{hint} ambiguous edges lead here" if hint else None})
    return {"verb": "impact", "symbol": symbol, "depth": depth, "ambiguous": ambiguous, "definitions": out}


def global_users(tables: dict[str, DataFrame], symbol: str, least: float = schema.MIN_CONFIDENCE) -> dict:
    rows = verbs.global_users(tables["edges"], tables["nodes"], symbol, least).orderBy("qname").collect()
    names = [d["qname"] for d in _definitions(tables, symbol, "global")]
    return {"verb": "globals", "symbol": symbol, "definitions": [{"qname": n, "writers": [r.qname for r in rows if r.definition == n and r.role == "writer"], "readers": [r.qname for r in rows if r.definition == n and r.role == "reader"]} for n in names]}


def variables_of(tables: dict[str, DataFrame], symbol: str, least: float = schema.MIN_CONFIDENCE) -> dict:
    rows = verbs.accesses_of(tables["edges"], tables["nodes"], symbol, least).orderBy("qname", "access", "site").collect()
    return {"verb": "vars-of", "symbol": symbol, "items": [{"qname": r.qname, "access": r.access, "site": r.site} for r in rows]}


def includers(tables: dict[str, DataFrame], header: str) -> dict:
    return {"verb": "who-includes", "symbol": header, "files": [r.file for r in verbs.includers(tables["edges"], tables["nodes"], header).orderBy("file").collect()]}


def co_changed(tables: dict[str, DataFrame], path: str) -> dict:
    return {"verb": "co-changed", "symbol": path, "items": [{"file": r.file, "count": r["count"]} for r in verbs.co_changed(tables["edges"], path).orderBy(F.desc("count"), "file").collect()]}


def notice(shown: int, total: int) -> str:
    return f"… +{total - shown} more (total {total}; a limit of 0 shows all)" if total > shown else ""


def text_of(document: dict) -> str:
    """A document as lines, with the same fields."""
    lines = [f"{document['verb']} {document['symbol']}"]
    if "definitions" in document and not document["definitions"]:
        return f"{document['symbol']}: not found"
    for d in document.get("definitions", []):
        lines.append(f"{d['qname']}" + (f"  {d['file']}:{d['line']}" if "file" in d else ""))
        for key, value in d.items():
            if isinstance(value, list) and value:
                lines.append(f"  {key}:")
                lines += [f"    {x['qname']}  {x.get('site', '')} {x.get('tags', '')}".rstrip() if isinstance(x, dict) else f"    {x}" for x in value]
                total = d.get(f"{key}_total", d.get("total", len(value)))
                lines += [f"    {notice(len(value), total)}"] if total > len(value) else []
            elif isinstance(value, dict):
                lines += [f"  {key} {k}: {v}" for k, v in sorted(value.items())]
    lines += [f"  {x}" for x in document.get("items", document.get("files", []))]
    return "\n".join(lines)
