"""Runs: maximal stretches of words that repeat with a period, found by block convolution.

The words of a batch of texts lie in one flat array of numbers. At the dyadic scale B a run with a
period in [B, 2B) that is long enough holds two whole aligned blocks of B words that come
again one period later. The sum of squared differences of a block and its image at each distance of
[B, 2B) is zero there; all distances of a block are got at once from an exact convolution: a
number-theoretic transform modulo a prime, over numbers small enough that a sum never reaches
the prime. Words fold into those numbers, so a zero may be false and is never missed; zeros in two
neighbouring blocks are seeds, extended on the words themselves to a run. Below ``DIRECT`` words a block's
differences are taken directly for all blocks at once. Blocks aren't transformed where a word doesn't come again
within 2B words, or where a known run covers the block and all its images: any period that
they show there is a multiple of the known one.

Defined results: null and empty texts have no words and no runs, and collapse to an empty text;
texts of any length are taken whole, and memory follows a batch's or the longest text's words;
runs that tie for the greatest exponent go by start, then period; repeated rows get a row each; an empty
table gives an empty table; a null doc_id is carried and gets no planted period; other columns aren't read.
"""

import hashlib
import re
import zlib
from functools import lru_cache
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame

from tallyforge.llm.common import over_batches

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has at least this many words, and this many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4
#: Scales below this are convolved directly; longer blocks by transforms.
DIRECT = 16
PRIME, GENERATOR = 998244353, 3
#: Words of texts worked on together, and numbers in a transform's batch.
BATCH_WORDS, TRANSFORM = 1 << 18, 1 << 20


@lru_cache(maxsize=64)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers of a root of unity of this order."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, -1, PRIME) if inverse else root
    out = np.ones(max(size // 2, 1), np.uint64)
    have = 1
    while have < len(out):  # doubling: the known powers times the next one
        step = pow(root, have, PRIME)
        out[have : 2 * have] = out[:have] * np.uint64(step) % np.uint64(PRIME)
        have *= 2
    return out


def transform(a: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row (a power of two long); the inverse undoes it."""
    rows, size = a.shape
    a, p = a.astype(np.uint64), np.uint64(PRIME)
    half, stride = size // 2, 1
    # Stockham's order: no permutation, each step reads halves and writes interleaved
    while half >= 1:
        a = a.reshape(rows, 2, half, stride)
        w = _roots(2 * half, inverse)[:, None]
        even, odd = a[:, 0] + a[:, 1], a[:, 0] + p - a[:, 1]
        a = np.stack([even % p, odd % p * w % p], axis=2).reshape(rows, size)
        half, stride = half // 2, stride * 2
    return a * np.uint64(pow(size, -1, PRIME)) % p if inverse else a


def zero_distances(x: np.ndarray, blocks: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) where the numbers of a block equal those a distance in [scale, 2 * scale) later.

    ``x`` holds numbers with ``scale * max(x)**2 < PRIME``; ``blocks`` are block numbers. Numbers beyond the end count as zeros;
    whoever asks checks the ends.
    """
    found_block, found_distance = [], []
    x = np.concatenate([x, np.zeros(3 * scale, x.dtype)]).astype(np.uint64)
    step = max(1, TRANSFORM // (2 * scale))
    for i in range(0, len(blocks), step):
        part = blocks[i : i + step]
        at = part[:, None] * scale
        own = x[at + np.arange(scale)]
        window = x[at + scale + np.arange(2 * scale)]
        window[:, -1] = 0  # the last distance ends before it
        squares = np.cumsum(window * window, axis=1)
        squares = np.concatenate([np.zeros((len(part), 1), np.uint64), squares], axis=1)
        moved = squares[:, scale : 2 * scale] - squares[:, :scale]
        flipped = np.zeros_like(window)
        flipped[:, 0] = own[:, 0]
        flipped[:, scale + 1 :] = own[:, :0:-1]  # correlation is convolution with the reversed block
        product = transform(transform(flipped) * transform(window) % np.uint64(PRIME), inverse=True)[:, :scale]
        total = (own * own).sum(axis=1)[:, None] + moved
        b, d = np.nonzero(total == 2 * product)
        found_block.append(part[b])
        found_distance.append(d + scale)
    empty = np.zeros(0, np.int64)
    return np.concatenate(found_block or [empty]), np.concatenate(found_distance or [empty])


def _matched(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the first places of both are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = a[at : min(at + step, n)] != b[at : min(at + step, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def _stretches(x: np.ndarray, d: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the maximal stretches of at least ``least`` places i with x[i] == x[i + d]."""
    if len(x) <= d:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    breaks = np.flatnonzero(x[:-d] != x[d:])
    edges = np.concatenate([[-1], breaks, [len(x) - d]])
    gaps = np.diff(edges) - 1
    long = np.flatnonzero(gaps >= least)
    return edges[long] + 1, gaps[long]


def _least(q: int) -> int:
    return max(MIN_LENGTH, MIN_PERIODS * q)


def runs_of(x: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs of flat words as (start, length, period) by start, then period.

    ``doc`` numbers each word's text; words of different texts must have different numbers in ``x``
    at the texts' ends, so that nothing matches across them: texts are parted by unique numbers here.
    """
    n = len(x)
    if n < MIN_LENGTH:
        return []
    # a unique separator after each text
    last = np.flatnonzero(np.diff(doc)) + 1
    cuts = np.concatenate([[0], last, [n]])
    flat = np.full(n + len(last), -1, np.int64)
    shift = np.searchsorted(last, np.arange(n), side="right")
    flat[np.arange(n) + shift] = x
    flat[flat < 0] = int(x.max()) + 1 + np.arange(len(last))
    longest = int(np.diff(cuts).max())
    original = lambda s: s - int(np.searchsorted(last + np.arange(len(last)), s))

    known: dict[tuple[int, int], int] = {}
    for q in range(1, min(DIRECT, longest // MIN_PERIODS + 1)):
        starts, lengths = _stretches(flat, q, _least(q) - q)
        for s, m in zip(starts.tolist(), lengths.tolist(), strict=True):
            known.setdefault((s, s + m + q), q)
    scale = DIRECT
    if longest >= MIN_PERIODS * scale:
        order = np.argsort(flat, kind="stable")
        again = np.full(len(flat), len(flat), np.int64)
        same = flat[order[1:]] == flat[order[:-1]]
        again[order[:-1][same]] = (order[1:] - order[:-1])[same]
    while longest >= MIN_PERIODS * scale:
        count = len(flat) // scale
        open_ = (again[: count * scale].reshape(count, scale) < 2 * scale).all(axis=1)
        for s, e in known:  # all images of these blocks lie in the run
            open_[-(-s // scale) : max(0, (e - 3 * scale) // scale + 1)] = False
        open_[:-1] &= open_[1:] | np.concatenate([[False], open_[:-2]])
        bound = max(2, int(((PRIME - 1) / scale) ** 0.5) - 1)
        blocks, distances = zero_distances(flat % bound, np.flatnonzero(open_), scale)
        keys = np.unique(distances * np.int64(count + 2) + blocks)  # by distance, then block
        pair = np.flatnonzero(np.diff(keys) == 1)
        until, of = -1, -1
        for key in keys[pair].tolist():
            d, b = divmod(key, count + 2)
            start = b * scale
            until = until if d == of else -1
            of = d
            if start < until or start + 2 * scale + d > len(flat) or not np.array_equal(flat[start : start + 2 * scale], flat[start + d : start + 2 * scale + d]):
                continue
            s = start - _matched(flat[:start][::-1], flat[d : start + d][::-1])
            until = start + _matched(flat[start:-d], flat[start + d :])
            if until + d - s >= _least(d):
                known.setdefault((s, until + d), d)
        scale *= 2
    out = []
    for (s, e), q in known.items():
        out.append((original(s), e - s, q))
    return sorted((s, m, q) for s, m, q in out)


class Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the planted period of every tenth document, by a checksum of its id."""
    h = -1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def found(texts: list[list[str]]):
    """(runs, kept words) of each list of words, runs as (start, length, period) within it."""
    i = 0
    while i < len(texts):
        part, total = [], 0
        while i < len(texts) and (not part or total + len(texts[i]) <= BATCH_WORDS):
            part.append(texts[i])
            total += len(texts[i])
            i += 1
        numbers = Numbers()
        x = np.fromiter((numbers[w] for words in part for w in words), np.int64, total)
        sizes = np.array([len(w) for w in part], np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        doc = np.repeat(np.arange(len(part)), sizes)
        runs = runs_of(x, doc)
        own = np.searchsorted(starts, [r[0] for r in runs], side="right") - 1 if runs else []
        by: dict[int, list] = {}
        covered = np.zeros(total + 1, np.int64)
        for k, (s, m, q) in zip(own, runs, strict=True):
            by.setdefault(int(k), []).append((s - int(starts[k]), m, q))
            covered[s + q] += 1
            covered[s + m] -= 1
        keep = (np.cumsum(covered[:-1]) == 0).tolist()
        for k, words in enumerate(part):
            at = int(starts[k])
            yield by.get(k, []), list(compress(words, keep[at : at + len(words)])) if k in by else words


def greatest(runs: list[tuple[int, int, int]]) -> tuple | None:
    """The run with the greatest exact length/period; ties by start, then period."""
    best = None
    for s, m, q in runs:  # by start, then period
        if best is None or m * best[2] > best[1] * q:
            best = (s, m, q)
    return best


FIELDS = {"doc_id": "bigint", "n_words": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"}


def _analysed(docs: DataFrame, fields: dict[str, str], row) -> DataFrame:
    """``row`` (doc_id, number of words, runs, kept words) gives the values of the fields, or a list of such rows."""

    def fn(c):
        ids, texts = c["doc_id"], c["text"]
        for i in range(0, len(texts), 512):
            part = ids[i : i + 512]
            words = [planted(WORD.findall(t or ""), k) for t, k in zip(texts[i : i + 512], part, strict=True)]
            rows = [r for k, w, (runs, kept) in zip(part, words, found(words), strict=True) for r in row(k, len(w), runs, kept)]
            yield {f: [r[j] for r in rows] for j, f in enumerate(fields)}

    return over_batches(docs.select("doc_id", "text"), fields, fn)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: its number of runs, the greatest, and the digests of all runs and of the collapsed text."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def row(doc_id, n, runs, kept):
        s, m, q = greatest(runs) or (None, None, None)
        return [(doc_id, n, len(runs), s, m, q, 1000 * m // q if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(kept)))]

    return _analysed(docs, FIELDS, row)


def runs(docs: DataFrame) -> DataFrame:
    """All runs: doc_id, start, length, period, in words."""
    fields = {"doc_id": "bigint", "start": "bigint", "length": "bigint", "period": "bigint"}
    return _analysed(docs, fields, lambda k, n, found_, kept: [(k, *r) for r in found_])


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id and the text whose runs keep their first period only, words joined by single spaces."""
    return _analysed(docs, {"doc_id": "bigint", "text": "string"}, lambda k, n, found_, kept: [(k, " ".join(kept))])
