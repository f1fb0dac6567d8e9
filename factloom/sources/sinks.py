"""Answers and summaries as text."""

from __future__ import annotations

import json

MAX_TEXT = 512 * 1024


def summary_lines(values: dict, prefix: str = "") -> str:
    return "\n".join(f"{prefix}{k}={v}" for k, v in values.items())


def bench_lines(values: dict) -> str:
    return summary_lines(values, "bench.")


def tool_output(summary: str, data: object) -> dict:
    return {"summary": sanitized(summary), "data": data}


def json_lines(rows: list[dict]) -> str:
    return "\n".join(json.dumps(r, ensure_ascii=False, default=str) for r in rows)


def sanitized(text: str, most: int = MAX_TEXT) -> str:
    """Control characters other than tab and line ends as blanks, cut at a character boundary within most bytes."""
    clean = "".join(" " if (ord(c) < 32 and c not in "\t\n\r") or ord(c) == 127 else c for c in text)
    raw = clean.encode()
    return clean if len(raw) <= most else raw[:most].decode("utf-8", "ignore")
