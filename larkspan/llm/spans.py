"""What span finders share: digests of (kind, start, end) in code points."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of `spans` that share no character with `taken`."""
    out, i = [], 0
    ordered = sorted((s, e) for _, s, e in taken)
    reach = 0
    for kind, s, e in sorted(spans, key=lambda x: x[1]):
        while i < len(ordered) and ordered[i][0] < e:
            reach = max(reach, ordered[i][1])
            i += 1
        if reach <= s:
            out.append((kind, s, e))
    return out
