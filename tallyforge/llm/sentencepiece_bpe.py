"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes units, which end before a word mark that follows something else and before a
newline; no piece reaches across such a border (checked on the vocabulary when it is loaded,
else the whole text is one unit). The units of a batch that aren't known yet lie in flat numpy arrays of symbols.
Each round finds the least pair rank of every unit, merges its leftmost pairs of that rank at
once, and compacts; a unit leaves when no pair is left. Where a merge would open a better
pair, only the unit's leftmost pair is merged in that round, which is what one merge at a
time would do.

Defined results: null and empty texts have no ids and decode to an empty text; characters
outside the vocabulary become byte pieces; repeated rows get a row each; an empty table gives
an empty table; other columns aren't read.
"""

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tallyforge.llm.common import over_batches, worker_cache
from tallyforge.llm.packing import vocabulary

MARK = "▁"
NONE = np.int64(1 << 40)
#: Units whose ids a Python worker keeps.
CACHED_UNITS = 700_000


class Names(dict):
    """Decimal ids of symbols: a piece's own, or those of the bytes of a character outside the vocabulary."""

    def __init__(self, size: int, byte_ids: dict[int, int], unknown: int):
        super().__init__((i, str(i)) for i in range(size))
        self.size, self.byte_ids, self.unknown = size, byte_ids, unknown

    def __missing__(self, symbol: int) -> str:
        raw = chr(symbol - self.size).encode("utf-8", "surrogatepass")
        return ",".join(str(self.byte_ids.get(b, self.unknown)) for b in raw)


class Model:
    """The pieces of a model as tables: symbols by character, ranks of pairs, bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        special = {i for i in range(n) if m.is_control(i) or m.is_unknown(i) or m.is_unused(i)}
        byte = {i: int(m.id_to_piece(i)[3:5], 16) for i in range(n) if m.is_byte(i)}
        pieces = {m.id_to_piece(i): i for i in range(n) if i not in special and i not in byte}
        self.size, self.names = n, Names(n, {b: i for i, b in byte.items()}, m.unk_id())
        self.separable = not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
        self.content = {str(i): b"" for i in range(n)} | {str(i): p.replace(MARK, " ").encode() for p, i in pieces.items()} | {str(i): bytes([b]) for i, b in byte.items()}
        symbol = lambda p: pieces.get(p, self.size + ord(p) if len(p) == 1 else None)
        self.chars = {p: i for p, i in pieces.items() if len(p) == 1}
        pairs = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 21) + b] = i
        order = {s: r for r, s in enumerate(sorted({m.get_score(i) for i in pieces.values()}, reverse=True))}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = np.array([order[m.get_score(i)] for i in self.merged.tolist()], np.int64)
        # open addressing by a multiplicative hash: most lookups end at the first probe
        self.shift = 64 - (len(pairs) * 4).bit_length()
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.probes = 1
        for j, h in enumerate(self._hash(self.keys).tolist()):
            k = 0
            while self.slots[(h + k) & (len(self.slots) - 1)] >= 0:
                k += 1
            self.slots[(h + k) & (len(self.slots) - 1)] = j
            self.probes = max(self.probes, k + 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of each pair in the table, or -1."""
        keys = (a << 21) + b
        h, out, left = self._hash(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k in range(self.probes):
            slot = self.slots[(h[left] + k) & (len(self.slots) - 1)]
            hit = (slot >= 0) & (self.keys[slot] == keys[left])
            out[left[hit]] = slot[hit]
            left = left[(slot >= 0) & ~hit]
            if not len(left):
                break
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        i = self.find(a, b)
        return np.where(i >= 0, self.ranks[i], NONE)


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


def merge(model: Model, units: list[str]) -> list[str]:
    """The ids of each unit, joined by commas."""
    sizes = np.fromiter(map(len, units), np.int64, len(units))
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
    distinct, back = np.unique(codes, return_inverse=True)
    sym = np.array([model.chars.get(chr(c), model.size + c) for c in distinct.tolist()], np.int64)[back]
    unit = np.repeat(np.arange(len(units)), sizes)
    out, name = [""] * len(units), model.names.__getitem__
    ranks = np.full(len(sym), NONE)
    ranks[:-1] = np.where(unit[:-1] == unit[1:], model.rank(sym[:-1], sym[1:]), NONE)
    while len(sym):
        heads = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        least = np.minimum.reduceat(ranks, heads)
        lengths = np.diff(np.r_[heads, len(sym)])
        done = least >= NONE
        if done.any():
            gone = np.repeat(done, lengths)
            flat, at = sym[gone].tolist(), 0
            for u, n in zip(unit[heads[done]].tolist(), lengths[done].tolist(), strict=True):
                out[u] = ",".join(map(name, flat[at : at + n]))
                at += n
            sym, unit, ranks, lengths, least = sym[~gone], unit[~gone], ranks[~gone], lengths[~done], least[~done]
            if not len(sym):
                break
        best = np.repeat(least, lengths)
        at = np.flatnonzero((ranks == best) & (best < NONE))
        # of pairs that overlap in a run, every second one from the left
        run = np.r_[True, np.diff(at) > 1]
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        first = np.r_[True, unit[at[1:]] != unit[at[:-1]]]
        new = model.merged[model.find(sym[at], sym[at + 1])]
        if not first.all():
            # a unit with several merges: do they open a pair that isn't worse than this one?
            after = sym.copy()
            after[at] = new
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            kept = np.flatnonzero(keep)
            where = np.searchsorted(kept, at)
            bad = np.zeros(len(at), bool)
            for side in (-1, 0):
                i = where + side
                ok = (i >= 0) & (i + 1 < len(kept))
                a, b = kept[np.where(ok, i, 0)], kept[np.where(ok, i + 1, 0)]
                bad |= ok & (unit[a] == unit[b]) & (model.rank(after[a], after[b]) <= best[at])
            if bad.any():
                single = np.isin(unit[at], unit[at[bad]])
                take = first | ~single
                at, new = at[take], new[take]
        sym[at] = new
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        shift = np.cumsum(keep) - 1
        sym, unit, ranks, at = sym[keep], unit[keep], ranks[keep], shift[at]
        for i in (at - 1, at):  # only the neighbours of what was merged have new pairs
            i = i[i >= 0]
            j = np.minimum(i + 1, len(sym) - 1)
            ranks[i] = np.where((j > i) & (unit[i] == unit[j]), model.rank(sym[i], sym[j]), NONE)
    return out


def units_of(model: Model, text: str) -> list[str]:
    """The units of a text, without the mark that begins all of them but those that begin with a newline."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    if not model.separable:
        return [text.replace(" ", MARK)]
    words = text.replace("\n", " \n").split(" ")
    if "" not in words:
        return words
    out, marks = [], ""
    for w in words:
        if not w:
            marks += MARK
        elif w[0] != "\n":
            out.append(marks + w)
            marks = ""
        else:
            out += [marks[1:], w] if marks else [w]
            marks = ""
    return [*out, marks[1:]] if marks else out


def encoded(texts: list[str | None], path: str):
    """Each text's ids, joined by commas."""
    model, known = load(path), worker_cache(("units", path))
    for i in range(0, len(texts), 256):
        if len(known) > CACHED_UNITS:
            known.clear()
        part = [units_of(model, t or "") for t in texts[i : i + 256]]
        fresh = list(set().union(*part).difference(known))
        if fresh:
            known.update(zip(fresh, merge(model, [u if u[:1] == "\n" and model.separable else MARK + u for u in fresh]), strict=True))
        for units in part:
            yield ",".join(map(known.__getitem__, units))


def encode(texts: list[str | None], path: str) -> list[list[int]]:
    return [[int(i) for i in ids.split(",")] if ids else [] for ids in encoded(texts, path)]


def decode(ids: str, path: str) -> str:
    """The text of ids joined by commas: their bytes, without the mark that every text begins with."""
    raw = b"".join(map(load(path).content.__getitem__, ids.split(","))) if ids else b""
    return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id and ids."""
    path = path or vocabulary("piece_bpe_32k.model")
    return over_batches(docs.select("doc_id", "text"), {"doc_id": "bigint", "ids": "array<int>"}, lambda c: {"doc_id": c["doc_id"], "ids": encode(c["text"], path)})


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """Rows of doc_id and ids as doc_id and text; null ids give an empty text."""
    path = path or vocabulary("piece_bpe_32k.model")
    return over_batches(ids.select("doc_id", "ids"), {"doc_id": "bigint", "text": "string"}, lambda c: {"doc_id": c["doc_id"], "text": [decode(",".join(map(str, x or [])), path) for x in c["ids"]]})


DIGEST = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text that they decode to."""
    path = path or vocabulary("piece_bpe_32k.model")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def fn(c):
        for i in range(0, len(c["text"]), 256):
            n, ids, texts = [], [], []
            for own in encoded(c["text"][i : i + 256], path):
                n.append(own.count(",") + 1 if own else 0)
                ids.append(sha(own))
                texts.append(sha(decode(own, path)))
            yield {"doc_id": c["doc_id"][i : i + 256], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": texts}

    return over_batches(docs.select("doc_id", "text"), DIGEST, fn)
