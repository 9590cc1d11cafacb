"""Shown files as text, flat rows or JSON lines. What is rendered is bounded by the display limits, so it is collected."""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import DataFrame

from .select import WEAK_RATIO, Limits, Selection


def wants_color(flag: str, env: dict[str, str], tty: bool) -> bool:
    """always and never as said; else NO_COLOR and a dumb terminal forbid, FORCE_COLOR and CLICOLOR_FORCE ask, CLICOLOR=0 forbids, and a terminal has it."""
    if flag != "auto":
        return flag == "always"
    if env.get("NO_COLOR") or env.get("TERM") == "dumb":
        return False
    forced = any(env.get(k, "0") not in ("", "0") for k in ("FORCE_COLOR", "CLICOLOR_FORCE"))
    return forced or (tty and env.get("CLICOLOR") != "0")


def _painted(text: str, code: str, color: bool) -> str:
    return f"\x1b[{code}m{text}\x1b[0m" if color else text


def _width(c: str) -> int:
    return 0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1


def cut(text: str, columns: int) -> str:
    """At most so many display columns, the last of them an ellipsis if something is cut."""
    if sum(map(_width, text)) <= columns:
        return text
    out, used = [], 0
    for c in text:
        used += _width(c)
        if used > columns - 1:
            break
        out.append(c)
    return "".join(out) + "…"


def round4(x: float) -> float:
    """Half away from zero."""
    return int(abs(x) * 10_000 + 0.5) / 10_000 * (1 if x >= 0 else -1)


def collect(sel: Selection) -> dict[int, list[dict]]:
    """Per query the shown files in order, with their regions and lines."""
    out: dict[int, list[dict]] = {}
    for row in sel.shown.orderBy("query_idx", "place").collect():
        f = row.asDict(recursive=True)
        regions = sorted(({**r, "lines": []} for r in f["regions"]), key=lambda r: r["start"])
        alone, home = [], {r["start"]: r["lines"] for r in regions}
        for h in sorted(f["lines"], key=lambda h: h["line"]):
            home.get(h["region"], alone).append({"line": h["line"], "p": h["p"], "text": h["text"]})
        out.setdefault(f["query_idx"], []).append(f | {"regions": regions, "lines": alone})
    return out


def _rows(f: dict) -> list[dict]:
    return sorted([*f["regions"], *f["lines"]], key=lambda r: r.get("start", r.get("line")))


def flat(files: list[dict]) -> str:
    out = []
    for f in files:
        if f["weak"]:
            continue
        for r in _rows(f):
            if "start" in r:
                out.append(f"{f['path']}:{r['start']}-{r['end']}:{r['p']:.2f}:{r['label']}")
            out += [f"{f['path']}:{h['line']}:{h['p']:.2f}:{h['text']}" for h in (r["lines"] if "start" in r else [r])]
    return "".join(x + "\n" for x in out)


def json_lines(query: str, files: list[dict]) -> str:
    line = lambda h: {"line": h["line"], "p": round4(h["p"]), "text": h["text"]}
    rows = [{
        "query": query, "path": f["path"], "relevance": round4(f["relevance"]), "section_relevance": round4(f["score"]), "confidence": round4(f["confidence"]), "match": "weak" if f["weak"] else "strong",
        "regions": [{"start": r["start"], "end": r["end"], "p": round4(r["p"]), "label": r["label"], "label_line": r["label_line"], "lines": [line(h) for h in r["lines"]]} for r in f["regions"]],
        "lines": [line(h) for h in f["lines"]], "more_regions": f["more_regions"], "more_lines": f["more_lines"],
    } for f in files]
    return "".join(json.dumps(r, ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows)


def files_lines(query: str, files: DataFrame, as_json: bool) -> str:
    rows = files.orderBy("place").collect()
    if as_json:
        return "".join(json.dumps({"query": query, "path": r["path"], "relevance": round4(r["score"]), "confidence": round4(r["confidence"])}, ensure_ascii=False, separators=(",", ":")) + "\n" for r in rows)
    return "".join(f"{r['score']:.2f}  {r['path']}\n" for r in rows)


def grouped(files: list[dict], lim: Limits = Limits(), context: int = 0, source: dict[str, list[str]] | None = None, color: bool = False) -> str:
    """Headers with rows below them; source: the lines of shown files, for context."""
    out, announced = [], False
    for f in files:
        if f["weak"] and not announced:
            announced = True
            out.append(f"-- weaker: these files look related overall, but nothing in them reached {lim.threshold:.2f}; near misses (>= {WEAK_RATIO * lim.threshold:.2f}) shown\n")
        out.append(f"{_painted(f['path'], '1;35', color)}  relevance={f['relevance']:.2f}")
        lines, printed = (source or {}).get(f["path"], []), set()
        for r in _rows(f):
            hits = {h["line"]: h for h in (r["lines"] if "start" in r else [r])}
            if "start" in r:
                where = f"{r['start']}-{r['end']}"
                out.append(f"{_painted(f'{where:>11}', '32', color)}  {r['p']:.2f}  {cut(r['label'], 110)}")
                printed.add(r["label_line"])
            for n in sorted({k for h in hits for k in range(max(1, h - context), h + context + 1)} - printed):
                printed.add(n)
                if n in hits:
                    out.append(f"{_painted(f'{n:>11}', '32', color)}  {hits[n]['p']:.2f}  {cut(hits[n]['text'], 200)}")
                elif n <= len(lines) and lines[n - 1].strip():
                    out.append(f"{n:>11}        {cut(lines[n - 1].rstrip(), 200)}")
        more = [f"{n} more {what}{'s' * (n != 1)} (raise {flag})" for n, what, flag in ((f["more_regions"], "region", "--max-regions"), (f["more_lines"], "line", "-m")) if n]
        if more:
            out.append(f"{'':>11}  not shown: {', '.join(more)}")
        out.append("")
    return "".join(x + "\n" for x in out)
