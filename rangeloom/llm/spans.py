"""Spans in texts: places are code points, ends exclusive."""

from __future__ import annotations

import hashlib

from pyspark.sql import types as T

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def fields(kinds: tuple[str, ...]) -> list[tuple[str, T.DataType]]:
    counts = [(f"n_{k}", T.LongType()) for k in kinds]
    return [*counts, ("base_sha256", T.StringType()), ("spans", T.StringType())]


def columns(base: list[list[Span]], all_spans: list[list[Span]], kinds: tuple[str, ...]) -> dict[str, object]:
    out: dict[str, object] = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in kinds}
    return out | {"base_sha256": [digest(b) for b in base], "spans": [joined(s) for s in all_spans]}


def redacted(text: str, spans: list[Span]) -> str:
    """text with each span replaced by its kind in angle brackets; of overlapping ones, their union by the first kind."""
    out, at, end, kind = [], 0, -1, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"<{kind.upper()}>")
            at = end
        out.append(text[at:a])
        end, kind = b, k
    if end >= 0:
        out.append(f"<{kind.upper()}>")
        at = end
    return "".join(out) + text[at:]
