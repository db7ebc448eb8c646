"""Sets of time ranges [start, end) in microseconds, as sorted lists that don't touch."""

from __future__ import annotations

Ranges = list[list[int]]


def merged(ranges: Ranges, most: int = 1_000) -> Ranges:
    """One list of disjoint ranges; of more than `most`, those with the smallest gaps are joined (a superset)."""
    out: Ranges = []
    for s, e in sorted(ranges):
        if s >= e:
            continue
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    if len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda k: out[k][0] - out[k - 1][1])
        joined = set(gaps[: len(out) - most])
        kept: Ranges = []
        for k, (s, e) in enumerate(out):
            if k in joined:
                kept[-1][1] = e
            else:
                kept.append([s, e])
        out = kept
    return out


def inside(ranges: Ranges, low: int, high: int) -> Ranges:
    return [[max(s, low), min(e, high)] for s, e in ranges if s < high and e > low]


def outside(ranges: Ranges, low: int, high: int) -> Ranges:
    return [r for s, e in ranges for r in ([s, min(e, low)], [max(s, high), e]) if r[0] < r[1]]


def widened(ranges: Ranges, size: int, origin: int) -> Ranges:
    """Ranges of whole buckets of that size, which count from origin."""
    return merged([[s - (s - origin) % size, e + (origin - e) % size] for s, e in ranges])
