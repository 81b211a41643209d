"""Sequence functions for the parsers whose steps are sequential: plain Python on token lists."""

from __future__ import annotations

import math
from collections.abc import Sequence

Token = str | None


def longest_common(a: Sequence[Token], b: Sequence[Token]) -> list[Token]:
    """A longest common subsequence; read from the ends, equal tokens pair first, then the first list is shortened."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        row, up = table[i], table[i - 1]
        for j, y in enumerate(b, 1):
            row[j] = up[j - 1] + 1 if x == y else max(up[j], row[j - 1])
    out: list[Token] = []
    i, j = len(a), len(b)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
    return out[::-1]


def edit_table(a: Sequence[Token], b: Sequence[Token], wild: bool = False) -> list[list[int]]:
    """The Levenshtein table over tokens; with ``wild`` a wildcard on either side costs nothing."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        up, row = table[-1], [i]
        for j, y in enumerate(b, 1):
            same = x == y or (wild and (x is None or y is None))
            row.append(min(up[j] + 1, row[j - 1] + 1, up[j - 1] + (not same)))
        table.append(row)
    return table


def edit_distance(a: Sequence[Token], b: Sequence[Token], wild: bool = False) -> int:
    return edit_table(a, b, wild)[-1][-1]


def late_edit_distance(a: Sequence[str], b: Sequence[str], centre: float = 1.0) -> float:
    """The sum over the edit script of 1 / (1 + e^(end - centre)): edits late in the first list weigh little.

    The script is traced from the ends; among the cheapest predecessors the diagonal comes first, then a deletion.
    """
    table, i, j, total = edit_table(a, b), len(a), len(b), 0.0
    far = math.inf
    while i or j:
        diagonal = table[i - 1][j - 1] if i and j else far
        delete = table[i - 1][j] if i else far
        insert = table[i][j - 1] if j else far
        least = min(diagonal, delete, insert)
        if diagonal == least:
            if table[i][j] != diagonal:
                total += 1 / (1 + math.exp(i - centre))
            i, j = i - 1, j - 1
        elif delete == least:
            total += 1 / (1 + math.exp(i - centre))
            i -= 1
        else:
            total += 1 / (1 + math.exp(i + 1 - centre))
            j -= 1
    return total


def local_alignment(a: Sequence[Token], b: Sequence[Token], same: int = 10, other: int = 1) -> list[tuple[Token, Token]]:
    """Aligned pairs of a local alignment whose gaps are free and whose mismatches score a little.

    Wildcards count as the word ``None``. Diagonal moves win ties, then steps in the second list; the last best cell
    starts the trace.
    """
    x, y = [str(t) for t in a], [str(t) for t in b]
    score = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    best, at = 0, (0, 0)
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            score[i][j] = max(0, score[i - 1][j], score[i][j - 1], score[i - 1][j - 1] + (same if x[i - 1] == y[j - 1] else other))
            if score[i][j] >= best:
                best, at = score[i][j], (i, j)
    (i, j), out = at, []
    while i and j:
        here = score[i][j]
        if here == score[i - 1][j - 1] + (same if x[i - 1] == y[j - 1] else other):
            i, j = i - 1, j - 1
            out.append((x[i], y[j]))
        elif here == score[i][j - 1]:
            j -= 1
            out.append((None, y[j]))
        else:
            i -= 1
            out.append((x[i], None))
    return out[::-1]


def merge_tokens(a: Sequence[Token], b: Sequence[Token]) -> list[Token]:
    """The token where both agree, else a wildcard."""
    return [x if x == y else None for x, y in zip(a, b, strict=False)]


def covers(parent: Sequence[Token], child: Sequence[Token]) -> bool:
    return len(parent) == len(child) and all(p is None or p == c for p, c in zip(parent, child, strict=True))
