"""Best-fit packing of token sequences, planned on the histogram of lengths.

Pieces of one length are alike, so the plan is made on counts by length (as many numbers as the
capacity, however large the corpus): large pieces, above a third of the capacity, are paired
greedily, the largest with the largest partner that still fits, at most two to a sequence; then
smaller pieces, the largest first, go where the least room is left that holds them. The plan
lists runs of like placements; each piece finds its own by its rank among the pieces of its length.

Defined results: a null or empty text is the single id 0; only documents longer than the
capacity are cut, whatever their length; pieces of one length are alike, so ties go by doc_id, piece and ids, and equal rows in any
order; repeated rows are packed each; an empty table gives an empty table; other
columns aren't read.
"""

import string
import unicodedata
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, over_batches, ranked, stored, worker_cache

CAPACITY = 2048
END_ID = 0
#: Words whose ids a Python worker keeps; texts looked up at once; words that go to the tokenizer in one row.
CACHED_WORDS = 600_000
BLOCK = 256
ROW = 100


def vocabulary(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Words:
    """Ids of words, kept: the tokenizer drops white space and never merges across it.

    Spaces and newlines part words here; other white space stays for the tokenizer. Two shortcuts
    hold only for a tokenizer that folds case, and takes a run of letters, and the run of punctuation behind it,
    apart; this is tried when it is loaded, on all that the shortcuts use. Else words go to it as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.known = path, Tokenizer.from_file(path), {}
        vocabulary_ = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary_.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary_.items() if t.endswith("</w>")]] = True
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = frozenset(c for c in map(chr, range(0x250)) if self._folds(c))
        self.latin = all(self._ids(x + chr(i)) == self._ids((x + chr(i)).lower()) for i in range(256) for x in ("", "a", "1", "."))
        self.stops = "".join(c for c in string.punctuation if self._apart(c))

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _folds(self, c: str) -> bool:
        """A letter that stays one, alone or folded, with the same ids, one of which ends it."""
        low = c.lower()
        same = c.isalpha() and len(low) == 1 and low.isalpha() and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", low) == low
        return same and self._ids(c) == self._ids(low) and self._ids("a" + c) == self._ids("a" + low) and self._one(low) and self._one("a" + low)

    def _one(self, word: str) -> bool:
        ids = self._ids(word)
        return bool(ids) and np.flatnonzero(self.ends[ids]).tolist() == [len(ids) - 1]

    def _apart(self, c: str) -> bool:
        return all(self._ids(x + c + d) == self._ids(x) + self._ids(c + d) for x in ("a", "b1", "ÿ") for d in ("", *string.punctuation))

    def learn(self, words: set[str]) -> None:
        known, letters, stops, new, ended = self.known, self.letters, self.stops, set(), []
        for w in words:
            base = w.rstrip(stops)
            if len(base) == len(w) or not base or base[-1] not in letters:
                new.add(w)
            else:  # the punctuation behind a letter stands apart
                end = w[len(base) :]
                new.add(base)
                new.add(end)
                ended.append((w, base, end))
        new = new.difference(known)
        plain = list(filter(letters.issuperset, filter(None, new)))
        rest = list(new.difference(plain))
        # words of letters go in rows; each ends with the only id that can end a word
        rows = [plain[i : i + ROW] for i in range(0, len(plain), ROW)]
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            end = np.flatnonzero(self.ends[ids]) + 1
            if len(end) != len(row):
                rest += row
                continue
            raw, at = ids.tobytes(), 0
            for w, to in zip(row, (4 * end).tolist(), strict=True):
                known[w] = raw[at:to]
                at = to
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        for w, base, end in ended:
            known[w] = known[base] + known[end]

    def folded(self, text: str | None) -> str | None:
        """The text with as few different words as give the same ids; None if it may hold a special token."""
        text = text or ""
        low = text.lower()
        if any(x in low for x in self.special):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return low if self.latin else text

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, known = [], worker_cache(("words", self.path))
        self.known = known
        for i in range(0, len(texts), BLOCK):
            if len(known) > CACHED_WORDS:
                known.clear()
            own = list(map(self.folded, texts[i : i + BLOCK]))
            part = [[] if t is None else t.replace("\n", " ").split(" ") for t in own]
            if fresh := set().union(*part).difference(known):
                self.learn(fresh)
            out += [self.whole(t) if f is None else b"".join(map(known.__getitem__, words)) for t, f, words in zip(texts[i : i + BLOCK], own, part, strict=True)]
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def _words(path: str) -> Words:
    return Words(path)


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers."""
    return _words(path).encode(texts)


PIECE = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint"}


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document (doc_id, text): doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def fn(c):
        for i in range(0, len(c["text"]), 512):
            out = {k: [] for k in PIECE}
            for doc, ids in zip(c["doc_id"][i : i + 512], token_bytes(c["text"][i : i + 512], path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for name, v in zip(PIECE, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        out[name].append(v)
            yield out

    return over_batches(docs.select("doc_id", "text"), PIECE, fn)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces in a sequence, offset) that place all pieces of a histogram."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c}
    used: dict[int, int] = defaultdict(int)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs (first sequence, how many)
    runs, sequences = [], 0

    def place(length: int, n: int, first: int, gap: int, per: int) -> None:
        runs.append((length, used[length], first, per, capacity - gap))
        used[length] += n

    large = [n for n in left if 3 * n > capacity]
    for a in large:
        while left[a]:
            b = next((b for b in large if b <= capacity - a and left[b] > (a == b)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            place(a, n, sequences, capacity, 1)
            left[a] -= n
            if b is not None:
                place(b, n, sequences, capacity - a, 1)
                left[b] -= n
            room[capacity - a - (b or 0)].append((sequences, n))
            sequences += n
    gaps = np.zeros(capacity + 1, bool)
    gaps[[g for g, r in room.items() if r]] = True
    for a in (n for n in left if 3 * n <= capacity):
        while left[a]:
            fits = np.flatnonzero(gaps[a:])
            if not len(fits):
                gap, per = capacity, capacity // a
                room[gap].append((sequences, -(-left[a] // per)))
                sequences += room[gap][-1][1]
            else:
                gap = int(fits[0]) + a
                per = gap // a
            first, n = room[gap].pop()
            whole = min(n, left[a] // per)
            if whole:
                place(a, whole * per, first, gap, per)
                left[a] -= whole * per
                room[gap - per * a].append((first, whole))
                gaps[gap - per * a] = True
            if whole < n and left[a] and left[a] < per:
                rest = left[a]
                place(a, rest, first + whole, gap, rest)
                room[gap - rest * a].append((first + whole, 1))
                gaps[gap - rest * a] = True
                left[a], whole = 0, whole + 1
            if whole < n:
                room[gap].append((first + whole, n - whole))
            gaps[gap] = bool(room[gap])
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All pieces with their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with Scratch(docs.sparkSession) as kept:
        return stored(_placed(kept.stored(pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity, end_id)), capacity))


def _placed(cut: DataFrame, capacity: int) -> DataFrame:
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most as many rows as the capacity
    runs = sorted(plan(counts, capacity))
    shift = 44
    key = np.array([(r[0] << shift) + r[1] for r in runs], np.int64)
    first_rank, first, per, at = (np.array([r[i] for r in runs], np.int64) for i in (1, 2, 3, 4))
    fields = {**PIECE, "sequence_id": "bigint", "offset": "bigint"}

    def fn(c):
        length, rank = np.array(c["length"], np.int64), np.array(c.pop("rank"), np.int64)
        i = np.searchsorted(key, (length << shift) + rank, "right") - 1
        own = rank - first_rank[i]
        return {**c, "sequence_id": first[i] + own // per[i], "offset": at[i] + own % per[i] * length}

    numbered = ranked(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    return over_batches(numbered.select(*PIECE, "rank"), fields, fn)
