"""Ordered alignment of two lists of lines; the only Python inside tasks.

The alignment is a longest common subsequence at every size. A row of its table is one
whole number whose bits say where the length grows, so a line takes a few operations on
it; halving one list and splitting the other where both halves fit best gives the pairs
in memory that is linear in the lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

# Bit rows of lines that occur again are kept while they take no more bytes than this.
KEPT_BYTES = 64_000_000


def _lengths(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of ``before`` and each prefix of ``after``."""
    m = len(after)
    order = np.argsort(after, kind="stable")
    edges = np.searchsorted(after[order], np.append(np.unique(after), np.iinfo(np.int64).max))
    places = {int(after[order[a]]): order[a:z] for a, z in zip(edges, edges[1:])}
    row = full = (1 << m) - 1
    kept: dict[int, int] = {}
    room = KEPT_BYTES // (m // 8 + 1)
    for token in before.tolist():
        match = kept.get(token)
        if match is None:
            at = places.get(token)
            if at is None:
                continue
            bits = np.zeros(m, bool)
            bits[at] = True
            match = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(kept) < room:
                kept[token] = match
        both = row & match
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(m // 8 + 1, "little"), np.uint8), bitorder="little")[:m]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _same_head(lhs: np.ndarray, rhs: np.ndarray) -> int:
    n = min(len(lhs), len(rhs))
    differ = np.flatnonzero(lhs[:n] != rhs[:n])
    return int(differ[0]) if len(differ) else n


def align(before: list, after: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence of two token lists.

    Equal heads and tails are matched, lines that the other side lacks are left out, and
    what remains is halved; each of these keeps the subsequence as long as it can be.
    """
    numbers: dict = {}
    lhs, rhs = (np.array([numbers.setdefault(t, len(numbers)) for t in side], np.int64) for side in (before, after))
    kept: list[tuple[int, int]] = []
    gaps = [(np.arange(len(lhs)), np.arange(len(rhs)))]
    while gaps:
        a, b = gaps.pop()
        while len(a) and len(b):
            n = _same_head(lhs[a], rhs[b])
            kept += zip(a[:n].tolist(), b[:n].tolist())
            a, b = a[n:], b[n:]
            n = _same_head(lhs[a][::-1], rhs[b][::-1])
            kept += zip(a[len(a) - n :].tolist(), b[len(b) - n :].tolist())
            a, b = a[: len(a) - n], b[: len(b) - n]
            here, there = np.isin(lhs[a], rhs[b]), np.isin(rhs[b], lhs[a])
            if here.all() and there.all():
                break
            a, b = a[here], b[there]
        if not len(a) or not len(b):
            continue
        if len(a) == 1:
            kept.append((int(a[0]), int(b[0])))
            continue
        middle = len(a) // 2
        head = _lengths(lhs[a[:middle]], rhs[b])
        tail = _lengths(lhs[a[middle:]][::-1], rhs[b][::-1])[::-1]
        split = int(np.argmax(head + tail))
        gaps += [(a[:middle], b[:split]), (a[middle:], b[split:])]
    return kept


def novel_between(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for before, after in pairs:
        rows = []
        for lhs, rhs in zip(before, after):
            if lhs is None or rhs is None:
                rows.append(([], []))
                continue
            lhs, rhs = list(lhs), list(rhs)
            kept = align(lhs, rhs)
            gone, new = {i for i, _ in kept}, {j for _, j in kept}
            rows.append(
                ([i for i in range(len(lhs)) if i not in gone], [j for j in range(len(rhs)) if j not in new])
            )
        yield pd.DataFrame(rows, columns=["lhs", "rhs"])
