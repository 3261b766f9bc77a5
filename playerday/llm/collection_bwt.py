"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

The strings are aligned at a common coordinate. Round by round, from the last column to the first,
one symbol of every string that reaches the column is put in front of its suffix. Symbols of
different columns count as different, so the suffixes of a column are one segment of the transform:
a round reads the segment before it from front to back, writes its own, and no later round touches
either again. Only the newest segment is in memory; the caller may write each one out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Segment(NamedTuple):
    """The suffixes that begin in one column, in order."""

    column: int
    #: The string of each suffix.
    who: np.ndarray
    #: Symbols that it shares with the suffix before it, capped.
    prefix: np.ndarray
    #: The symbol before it (the transform), -1 where the suffix is the whole string.
    bwt: np.ndarray


def segments(strings: list[bytes], first: np.ndarray, most: int = 200) -> Iterator[Segment]:
    """The segments of the transform, last column first. first[i] is the column of the first symbol of string i."""
    n = len(strings)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    data = np.frombuffer(b"".join(strings), np.uint8)
    base = np.cumsum(lengths) - lengths - first  # column + base: place in data
    end = first + lengths
    by_end = np.argsort(-end, kind="stable")
    begun = 0
    who, prefix = np.zeros(0, np.int64), np.zeros(0, np.uint8)
    for column in range(int(end.max(initial=0)), int(first.min(initial=0)) - 1, -1):
        upto = begun + int(np.searchsorted(-end[by_end[begun:]], -column, side="right"))
        if upto > begun:  # empty suffixes come before all others
            who = np.concatenate((by_end[begun:upto], who))
            prefix = np.concatenate((np.zeros(upto - begun, np.uint8), prefix))
            begun = upto
        bwt = np.full(len(who), -1, np.int16)
        at = np.flatnonzero(first[who] < column)
        symbol = data[base[who[at]] + column - 1]
        bwt[at] = symbol
        yield Segment(column, who, prefix, bwt)
        order = np.argsort(symbol, kind="stable")
        place, symbol = at[order], symbol[order]
        shared = np.zeros(len(place), np.uint8)
        asked = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        if len(asked):  # a shared symbol, then what the segment shares between the two; each stretch ends behind the next one's start
            asked = asked[np.argsort(-place[asked])]
            stretch = np.empty(2 * len(asked), np.int64)
            stretch[0::2], stretch[1::2] = place[asked - 1] + 1, place[asked] + 1
            least = np.minimum.reduceat(np.append(prefix, np.uint8(0)), stretch)[0::2]
            shared[asked] = np.minimum(least, most - 1) + 1
        who, prefix = who[place], shared


def repeated(strings: list[bytes], first: np.ndarray, places: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """By string: ranges (from, to) of the columns where a substring of that length begins that begins elsewhere too.

    places[i] tells in how many places string i stands. Substrings count as
    equal only at equal columns.
    """
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    starts = np.cumsum(lengths) - lengths
    hit = np.zeros(int(lengths.sum()) + 1, np.int8)
    for column, who, prefix, _ in segments(strings, first, length):
        long = first[who] + lengths[who] - column >= length
        if not long.any():
            continue
        run = np.cumsum(prefix < length) - 1
        total = np.bincount(run, weights=np.where(long, places[who], 0))
        found = who[long & (total[run] > 1)]
        hit[starts[found] + column - first[found]] = 1
    edges = np.flatnonzero(np.diff(hit, prepend=np.int8(0)))  # no range reaches the end of a string, so none runs into the next
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist()):
        i = int(np.searchsorted(starts, a, side="right")) - 1
        out[i].append((a - int(starts[i]) + int(first[i]), b - int(starts[i]) + int(first[i])))
    return out
