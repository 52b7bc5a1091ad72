"""Spans of text by kind, and the digests that queries give of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

#: (kind, start, end): code points, end exclusive.
Span = tuple[str, int, int]


def ordered(spans: Iterable[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the place of the kind in `kinds`, then by end."""
    return sorted(set(spans), key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode("ascii")).hexdigest()


def covered(spans: Iterable[Span]) -> list[tuple[int, int]]:
    """The stretches that spans cover, ascending and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def outside(spans: Iterable[Span], stretches: list[tuple[int, int]]) -> list[Span]:
    """Those of the spans, which ascend, that overlap none of the stretches. One sweep over both."""
    out, at = [], 0
    for span in spans:
        while at < len(stretches) and stretches[at][1] <= span[1]:
            at += 1
        if at == len(stretches) or span[2] <= stretches[at][0]:
            out.append(span)
    return out


def replaced(text: str, spans: list[Span]) -> str:
    """The text with every stretch that spans cover replaced by the kind of the first of them, in brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans, key=lambda s: (s[1], -s[2]))
    while i < len(spans):
        kind, a, b = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < b:
            b = max(b, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(out) + text[at:]
