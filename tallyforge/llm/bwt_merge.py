"""Repeated intervals of many short strings from the Burrows-Wheeler transforms of their shards.

``transform`` sorts the suffixes of one shard's strings and gives its transform; ``repeats``
merges the transforms of several shards without sorting suffixes anew. Its interleave says which
row of which shard stands at each place of the merged order. It begins as the shards one behind
the other and is refined: one round deals the rows by the symbol before them, in the order of
the interleave, which orders the rows by one more symbol. Where two neighbours part in a round, their
common prefix ends; an interval that holds only one row can't repeat with more symbols
before it either, so it leaves. After ``depth`` rounds what is left are the intervals with
common prefixes of ``depth`` symbols or more.

Symbols are bytes plus one (UTF-8 has none above 0xF7); 0 ends a string, and no two ends are alike.
"""

import numpy as np

END = 0


def _heads(x: np.ndarray) -> np.ndarray:
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def transform(strings: list[bytes]) -> bytes:
    """The transform of the strings; its first rows are their ends, in their order."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    n, stop = int(sizes.sum()), np.cumsum(sizes)
    x = np.zeros(n, np.uint8)
    inner = np.ones(n, bool)
    inner[stop - 1] = False
    x[inner] = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    number = np.repeat(np.arange(len(strings)), sizes)
    left = stop[number] - 1 - np.arange(n)  # symbols before the string's end
    # eight symbols as a number, without those behind the end
    key = np.concatenate([x, np.zeros(7, np.uint8)]).astype(np.uint64)
    for by in (1, 2, 4):
        key = (key[:-by] << np.uint64(8 * by)) | key[by:]
    key &= np.array([0] + [(1 << 64) - (1 << (64 - 8 * d)) for d in range(1, 9)], np.uint64)[np.minimum(left, 8)]
    order = np.argsort(key)
    head = _heads(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    known = 8
    while len(at := np.flatnonzero(~(head & np.r_[head[1:], True]))):
        i = order[at]
        further = np.where(left[i] < known, number[i], rank[np.minimum(i + known, n - 1)])
        both = (rank[i] << 32) | further
        sub = np.argsort(both)
        order[at], head[at] = i[sub], _heads(both[sub])
        rank[order[at]] = np.maximum.accumulate(np.where(head[at], at, 0))
        known *= 2
    before = np.zeros(n, np.uint8)
    before[1:] = x[:-1]  # an end stands before each string
    return before[order].tobytes()


def repeats(shards: list[tuple[bytes, int]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset in it, number of the interval) of all suffixes that share ``depth`` symbols or more with another.

    ``shards``: transforms and how many strings each holds; strings are numbered through all shards.
    """
    symbol = np.concatenate([np.frombuffer(b, np.uint8) for b, _ in shards])
    n = len(symbol)
    back = np.empty(n, np.int32)  # the row of a row's suffix with the symbol before it
    ends, at = [], 0
    for b, m in shards:
        back[at + np.argsort(np.frombuffer(b, np.uint8), kind="stable")] = np.arange(at, at + len(b))
        ends.append(np.arange(at, at + m))
        at += len(b)
    row = np.concatenate(ends)
    own = np.arange(len(row))
    string, to_end = np.zeros(n, np.int32), np.zeros(n, np.int32)
    size = np.zeros(len(row), np.int32)
    step = 0
    while len(row):  # from the ends back through all strings at once
        string[row], to_end[row], size[own] = own, step, step
        go = symbol[row] != END
        row, own, step = back[row[go]], own[go], step + 1
    interleave, interval = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    for _ in range(depth):
        before = symbol[interleave]
        go = np.flatnonzero(before != END)
        before = before[go]
        go = go[by := np.argsort(before, kind="stable")]
        before, interleave, interval = before[by], back[interleave[go]], interval[go]
        parts = _heads(before)
        parts[1:] |= interval[1:] != interval[:-1]
        several = np.flatnonzero(~(parts & np.r_[parts[1:], True]))
        interleave, interval = interleave[several], np.cumsum(parts[several], dtype=np.int32)
        if not len(interleave):
            break
    of = string[interleave]
    return of, size[of] - to_end[interleave], interval
