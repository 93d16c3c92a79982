"""Reports of an audit as JSON and Markdown files with their digests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def facts_of(one_row: DataFrame) -> dict:
    """The single row of an aggregate as plain values, dates as text."""
    row = one_row.first()
    return {k: v if isinstance(v, int | float | bool | str) or v is None else str(v) for k, v in row.asDict().items()}


def as_json(report: dict) -> str:
    return json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def as_markdown(title: str, report: dict) -> str:
    lines = [f"# {title}", ""]
    for section, content in sorted(report.items()):
        lines += [f"## {section}", "", "| fact | value |", "|---|---|"]
        rows = content.items() if isinstance(content, dict) else enumerate(content, 1)
        lines += [f"| {k} | {v if v is not None else '-'} |" for k, v in rows] + [""]
    return "\n".join(lines)


def write_reports(folder: str, title: str, report: dict) -> dict[str, str]:
    """Writes both forms, each replaced in one step, and their SHA-256; returns the digests by file name."""
    digests = {}
    for name, text in (("report.json", as_json(report)), ("report.md", as_markdown(title, report))):
        digests[name] = hashlib.sha256(text.encode()).hexdigest()
        _replace(Path(folder, name), text)
    _replace(Path(folder, "SHA256SUMS"), "".join(f"{d}  {n}\n" for n, d in sorted(digests.items())))
    return digests


def _replace(path: Path, text: str) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=path.parent, delete=False) as file:
        file.write(text)
    os.replace(file.name, path)
