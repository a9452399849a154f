"""Answers at the edge: rows of a verb in an envelope, as JSON or as text.

The only place that brings rows to the driver; a verb's result is what a
person or tool reads.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Envelope:
    tool: str
    query: dict
    summary: str
    results: list[dict]
    warnings: list[str] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)

    @classmethod
    def of(
        cls, tool: str, query: dict, df: DataFrame, what: str = "result", warnings: list[str] | None = None, notes: list[str] | None = None,
    ) -> Envelope:
        rows = [{k: v for k, v in r.asDict(recursive=True).items() if v is not None} for r in df.collect()]
        return cls(tool, query, f"{len(rows)} {plural(what, len(rows))}", rows, warnings or [], notes or [])

    def to_dict(self) -> dict:
        out = {"tool": self.tool, "query": self.query, "summary": self.summary, "count": len(self.results), "results": self.results}
        return out | {k: v for k, v in (("warnings", self.warnings), ("notes", self.notes)) if v}

    def json(self, pretty: bool = False) -> str:
        return json.dumps(self.to_dict(), indent=2 if pretty else None, default=str, ensure_ascii=False)

    def text(self) -> str:
        """Summary, then rows in sections by ``section`` in the order of their first row, columns aligned."""
        out, groups = [self.summary], {}
        for row in self.results:
            groups.setdefault(row.get("section"), []).append(row)
        for name, rows in groups.items():
            out.append("")
            if name is not None:
                out.append(f"{name} ({len(rows)})")
            out += _aligned(rows)
        out += [f"note: {n}" for n in self.notes] + [f"⚠ {w}" for w in self.warnings]
        return "\n".join(out)


def plural(word: str, count: int) -> str:
    return word if count == 1 else word + ("es" if word.endswith(("s", "x")) else "s")


def _aligned(rows: list[dict]) -> list[str]:
    cells = []
    for row in rows:
        first = row.get("loc") or row.get("fqn") or row.get("path") or ""
        rest = [_shown(v) for k, v in row.items() if k not in ("section", "loc") and not (k in ("path", "line", "col") and "loc" in row) and v != first]
        cells.append([str(first), *rest])
    widths = [max((len(r[i]) for r in cells if i < len(r)), default=0) for i in range(max(map(len, cells), default=0))]
    return ["  " + "  ".join(c.ljust(widths[i]) for i, c in enumerate(r)).rstrip() for r in cells]


def _shown(value) -> str:
    return ", ".join(map(str, value)) if isinstance(value, list) else str(value)
