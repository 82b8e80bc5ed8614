"""Results as rows and text to show: answers, images, tables, traces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

#: Crops shown below a table answer: topic crops are added until so many are shown.
CROPS = 5


def vehicle(item: Mapping[str, Any]) -> str:
    return " ".join(str(item[f]) for f in ("brand", "model", "year") if item.get(f))


def pages(item: Mapping[str, Any]) -> str:
    if item.get("page_no") is not None:
        return str(item["page_no"])
    found = sorted(item.get("page_nos") or [])
    return "" if not found else str(found[0]) if len(found) == 1 else f"{found[0]}–{found[-1]}"


def evidence_rows(result: Mapping[str, Any]) -> list[list[Any]]:
    """citation, vehicle, pages, section, kind, score, content of each piece of evidence."""
    return [
        [e.get("citation_id"), vehicle(e), pages(e), " > ".join(e.get("section_path") or []), e.get("chunk_type", e.get("element_type", "evidence")), round(float(e.get("rerank_score", e.get("score", 0)) or 0), 4), e.get("content", "")]
        for e in result.get("evidence", [])
    ]


def text_answer(result: Mapping[str, Any]) -> str:
    """The answer with its status and, where refused, the reason."""
    head = f"**{result['status']}**" + (f" ({result['reason']})" if result.get("reason") and result["status"] != "answered" else "")
    return f"{head}\n\n{result['answer']}"


def gallery(result: Mapping[str, Any]) -> list[tuple[str, str]]:
    """(asset, caption) of image evidence, each asset once, pieces without one left out."""
    out: dict[str, str] = {}
    for e in result.get("evidence", []):
        if e.get("asset_path"):
            out.setdefault(e["asset_path"], f"[{e.get('citation_id')}] p.{pages(e)} · {' > '.join(e.get('section_path') or [])}")
    return list(out.items())


def table_crops(rows: Sequence[Mapping[str, Any]], crops: Sequence[Mapping[str, Any]], most: int = CROPS) -> list[tuple[str, str]]:
    """(asset, caption): all crops of verified rows first, then topic crops until ``most`` are shown; each asset once."""
    out: dict[str, str] = {}
    for e in rows:
        if e.get("asset_path"):
            out.setdefault(e["asset_path"], f"Verified source [{e.get('citation_id')}] · p.{pages(e)} · {' > '.join(e.get('section_path') or [])}")
    for e in crops:
        asset = e.get("asset_path")
        if not asset or asset in out:
            continue
        out[asset] = f"#{e['rank']} · p.{pages(e)} · {' > '.join(e.get('section_path') or [])}"
        if len(out) >= most:
            break
    return list(out.items())


def trace_markdown(trace: Sequence[Mapping[str, Any]]) -> str:
    """A workflow's events as a Markdown table."""
    rows = [f"| {t['sequence']} | {t['node']} | {t['status']} | {t['latency_ms']} | " + ", ".join(f"{k}: {v}" for k, v in t["details"].items()).replace("|", "\\|") + " |" for t in trace]
    return "\n".join(["| # | Step | Status | ms | Details |", "|---:|---|---|---:|---|", *rows])
