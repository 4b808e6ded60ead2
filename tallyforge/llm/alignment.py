"""Alignment of two tokenizers over the same bytes, by sparse incidence products.

A is a byte-level BPE, B a SentencePiece BPE. Both cut the bytes of a text; matrices in compressed rows
hold which token covers which byte and which group. The row product A.B^T over bytes gives the overlap
links, whose weights are shared bytes; those of tokens that end at the same byte are the end links. The same product
over groups, the stretches between common ends, gives the shared-group links.

Neither tokenizer merges across the start of a space or newline that follows something else (checked on B's
vocabulary when it is loaded, else a text is one unit). So texts are cut there, equal units have
equal alignments, and the matrices of a batch are made of the units that a Python worker doesn't know yet.

An id pair's count over the corpus never comes to the driver: tasks gather texts into chunks of bounded size, a chunk lists its
distinct pairs once, pairs are summed by shuffle, and each chunk gets the counts of its own pairs back. So one frequent pair
has a row per chunk, not per text.

Defined results: null and empty texts, and texts that one of the tokenizers doesn't give back byte for byte, have no
tokens: zeros and empty groups; texts of any length are taken whole; pairs that tie for the highest count of
their B id are all best; repeated rows are counted and returned each; an empty table gives an empty table; a null
doc_id is carried; other columns aren't read.
"""

import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import sentencepiece_bpe
from tallyforge.llm.common import Scratch, arrow_schema, ddl, over_batches, stored, worker_cache
from tallyforge.llm.packing import vocabulary

#: A space or newline that follows something else than white space starts a unit.
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Units that a Python worker keeps; links of a chunk; characters of units aligned together.
CACHED_UNITS, CHUNK_LINKS, BATCH_BYTES = 700_000, 500_000, 1 << 20
#: Units that go to A's tokenizer in one row.
ROW_UNITS = 100
#: A pair of ids as one number.
PAIR = 1 << 32


class Rows:
    """A sparse matrix in compressed rows: row r has the columns indices[indptr[r]:indptr[r + 1]]."""

    def __init__(self, indptr: np.ndarray, indices: np.ndarray):
        self.indptr, self.indices = indptr, indices

    @classmethod
    def of_ends(cls, ends: np.ndarray) -> "Rows":
        """Tokens by bytes: a token covers the bytes from the last one's end to its own."""
        n = int(ends[-1]) if len(ends) else 0
        return cls(np.concatenate([[0], ends]), np.arange(n))

    @classmethod
    def of_columns(cls, columns: np.ndarray) -> "Rows":
        """One column for each row."""
        return cls(np.arange(len(columns) + 1), columns)

    def transposed(self, n: int) -> "Rows":
        """Columns as rows; rows come in order within each."""
        rows = np.repeat(np.arange(len(self.indptr) - 1), np.diff(self.indptr))
        order = np.argsort(self.indices, kind="stable") if np.any(np.diff(self.indices) < 0) else slice(None)
        return Rows(np.concatenate([[0], np.cumsum(np.bincount(self.indices, minlength=n))]), rows[order])


def row_product(a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links (row of a, column of b, weight) of the product: row by row, the rows of b that a row of a names are merged and summed."""
    rows = np.repeat(np.arange(len(a.indptr) - 1), np.diff(a.indptr))
    sizes = np.diff(b.indptr)[a.indices]
    begins = np.cumsum(sizes) - sizes
    columns = b.indices[np.arange(int(sizes.sum())) + np.repeat(b.indptr[a.indices] - begins, sizes)]
    rows = np.repeat(rows, sizes)
    if not len(rows):
        return rows, columns, rows
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    if np.any((columns[1:] < columns[:-1]) & (rows[1:] == rows[:-1])):  # a row met its columns out of order
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
        new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
    at = np.flatnonzero(new)
    return rows[at], columns[at], np.diff(np.append(at, len(rows)))


def overlap_links(ends_a: np.ndarray, ends_b: np.ndarray):
    """Pairs of tokens that share bytes, and how many."""
    b = Rows.of_ends(ends_b)
    return row_product(Rows.of_ends(ends_a), b.transposed(len(b.indices)))


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common ends, and the group of each token of A and B."""
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return common, np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)


def shared_group_links(ends_a: np.ndarray, ends_b: np.ndarray):
    """Pairs of tokens of the same group; as many as the sum over groups of the product of their sizes."""
    common, of_a, of_b = groups(ends_a, ends_b)
    return row_product(Rows.of_columns(of_a), Rows.of_columns(of_b).transposed(len(common)))


def _bytes_of_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.path_b = Tokenizer.from_file(path_a), path_b
        self.a.encode_special_tokens = True
        letters = _bytes_of_letters()
        self.bytes_a = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.b = sentencepiece_bpe.load(path_b)
        self.bytes_b = {int(i): raw for i, raw in self.b.content.items()}
        self.sizes_a, self.sizes_b = (np.array([len(of.get(i, b"")) for i in range(max(of) + 1)]) for of in (self.bytes_a, self.bytes_b))
        # each id with what follows it within its group's side, and at the side's end
        self.names = [f"{i}{e}" for i in range(len(self.sizes_a)) for e in ",|"] + [f"{i}{e}" for i in range(len(self.sizes_b)) for e in ",;"]

    def units(self, text: str) -> list[str]:
        text = " " + text
        return UNIT.findall(text) if self.b.separable else [text]

    def encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all units in a row, B's ids, and how many B ids each unit has."""
        rows, row = [], []
        for u in units:
            if self.b.separable and u[0] in " \n" and not u[-1].isspace():
                row.append(u)  # units that part from their neighbours anywhere go to A together
            else:
                rows += ["".join(row), u] if row else [u]
                row = []
            if len(row) >= ROW_UNITS:
                rows.append("".join(row))
                row = []
        rows += ["".join(row)] if row else []
        a = np.fromiter(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(rows, add_special_tokens=False)), np.int64)
        b = sentencepiece_bpe.merge(self.b, [u.replace(" ", sentencepiece_bpe.MARK) for u in units])
        return a, np.fromstring(",".join(b), np.int64, sep=","), np.array([t.count(",") for t in b]) + 1

    def aligned(self, units: list[str]) -> list[tuple | None]:
        """(n_a, n_b, groups as text with a last semicolon, end links as pairs) of each unit; None where bytes differ."""
        a, b, n_b = self.encoded(units)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        raw = [u.encode() for u in units]
        own, whole = np.cumsum(list(map(len, raw))), b"".join(raw)
        until_a, until_b = np.searchsorted(ends_a, own) + 1, np.cumsum(n_b)
        same = until_a[-1] == len(a) and np.array_equal(ends_a[until_a - 1], own) and np.array_equal(ends_b[until_b - 1], own)
        if not (same and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == whole):
            half = len(units) // 2  # some unit doesn't come back: narrow it down
            return [*self.aligned(units[:half]), *self.aligned(units[half:])] if half else [None]
        x, y, _ = overlap_links(ends_a, ends_b)
        ended = ends_a[x] == ends_b[y]
        last_a, last_b = x[ended], y[ended]  # one end link closes each group
        pairs = (a[last_a] * PAIR + b[last_b]).tolist()
        # the groups' texts: A's tokens come after B's of earlier groups, B's after A's of their own
        nth_a, nth_b = np.arange(len(a)), np.arange(len(b))
        of_a, of_b = np.searchsorted(last_a, nth_a), np.searchsorted(last_b, nth_b)
        order = np.empty(len(a) + len(b), np.int64)
        order[nth_a + np.concatenate([[0], last_b + 1])[of_a]] = 2 * a + (last_a[of_a] == nth_a)
        order[nth_b + last_a[of_b] + 1] = 2 * (b + len(self.sizes_a)) + (last_b[of_b] == nth_b)
        names = list(map(self.names.__getitem__, order.tolist()))
        rows = zip(np.diff(until_a, prepend=0).tolist(), n_b.tolist(), (until_a + until_b).tolist(), (np.searchsorted(last_a, until_a - 1) + 1).tolist(), strict=True)
        out, i, g = [], 0, 0
        for m, n, j, h in rows:
            out.append((m, n, "".join(names[i:j]), pairs[g:h]))
            i, g = j, h
        return out


@lru_cache(maxsize=2)
def load(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Known(dict):
    """Units and their alignments: a unit that is asked for the first time gets an empty list, to be filled."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> list:
        self.fresh.append(unit)
        out = self[unit] = []
        return out

    def fill(self, pair: Pair) -> None:
        marked = [u for u in self.fresh if sentencepiece_bpe.MARK in u]  # the mark comes back as a space
        rest = [u for u in self.fresh if sentencepiece_bpe.MARK not in u] if marked else self.fresh
        for u in marked:
            self[u].extend(NO_TOKENS)
        i = 0
        while i < len(rest):
            size, j = 0, i
            while j < len(rest) and (j == i or size < BATCH_BYTES):
                size += len(rest[j])
                j += 1
            for u, found in zip(rest[i:j], pair.aligned(rest[i:j]), strict=True):
                self[u].extend(found or NO_TOKENS)
            i = j
        self.fresh = []


#: In a unit's place where a tokenizer doesn't give its bytes back.
NO_TOKENS = (-1, -1, "", [])


def alignments(texts: list[str | None], path_a: str, path_b: str):
    """For each text (n_a of its units, n_b, groups' texts, end links), or None if it has no tokens."""
    pair = load(path_a, path_b)
    kept = worker_cache(("alignments", path_a, path_b))
    for i in range(0, len(texts), 256):
        if len(kept.get("units", ())) > CACHED_UNITS:
            kept.clear()
        known = kept.setdefault("units", Known())
        part = [list(map(known.__getitem__, pair.units(t))) if t else None for t in texts[i : i + 256]]
        known.fill(pair)
        for units in part:
            found = tuple(zip(*units, strict=True)) if units else None
            yield found if found and min(found[0]) >= 0 else None


FIELDS = {"doc_id": "bigint", "n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string"}
#: A chunk's row has its distinct pairs and how often they occur, its texts' rows the places and numbers of theirs.
GATHERED = {"chunk": "bigint", "is_chunk": "boolean", **FIELDS, "pairs": "binary", "counts": "binary"}
LOOKED = {"chunk": "bigint", "pair": "bigint", "n": "bigint"}


def _gather(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Texts aligned and gathered into chunks; GATHERED."""
    schema, nothing = arrow_schema(GATHERED), np.zeros(0, np.int64)

    def run(batches):
        base, number, rows, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def closed():
            own = np.unique(np.concatenate([nothing, *(p for p, _ in held)]))
            total, at = np.zeros(len(own), np.int64), []
            for p, n in held:
                at.append(np.searchsorted(own, p))
                total[at[-1]] += n
            chunk = base + number
            out = [(chunk, False, *r, i.astype(np.int32).tobytes(), n.astype(np.int32).tobytes()) for r, i, (_, n) in zip(rows, at, held, strict=True)]
            out.append((chunk, True, None, 0, 0, 0, 0, "", own.tobytes(), total.tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc_id, found in zip(ids, alignments(texts, path_a, path_b), strict=True):
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, ""))
                    held.append((nothing, nothing))
                else:
                    n_a, n_b, groups_, pairs = found
                    own, counts = np.unique(np.fromiter(chain.from_iterable(pairs), np.int64), return_counts=True)
                    n = int(counts.sum())  # each group is closed by one end link
                    rows.append((doc_id, sum(n_a), sum(n_b), n, n, hashlib.sha256("".join(groups_)[:-1].encode()).hexdigest()))
                    held.append((own, counts))
                    size += len(own)
                if size > CHUNK_LINKS or len(rows) >= 20_000:
                    yield closed()
                    number, rows, held, size = number + 1, [], [], 0
        if rows:
            yield closed()

    return docs.select("doc_id", "text").mapInArrow(run, ddl(GATHERED))


def _listed(gathered: DataFrame) -> DataFrame:
    """(chunk, pair, n): the distinct pairs of each chunk."""
    schema = arrow_schema(LOOKED)

    def run(batches):
        for b in batches:
            for chunk, pairs, counts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                own = np.frombuffer(pairs, np.int64)
                for i in range(0, len(own), 100_000):
                    part = own[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk)), pa.array(part), pa.array(np.frombuffer(counts, np.int64)[i : i + 100_000])], schema=schema)

    return gathered.where("is_chunk").select("chunk", "pairs", "counts").mapInArrow(run, ddl(LOOKED))


def pair_counts(listed: DataFrame) -> DataFrame:
    """(pair, count, best): corpus-wide counts, and whether the count is the highest of the pair's B id.

    The highest counts have a row for each id of B's vocabulary at most, and so have a fixed bound.
    """
    counts = listed.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit(PAIR - 1)).alias("b")
    highest = counts.groupBy(b).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


OUT = {**FIELDS, "n_best": "bigint", "count_sum": "bigint"}


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row per document of ``docs`` (doc_id, text): numbers of tokens, groups and links, the groups' digest, best links and the sum of counts."""
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    schema = arrow_schema(OUT)

    def look_up(texts: pa.Table, pairs: pa.Table) -> pa.Table:
        order = np.argsort(pairs["pair"].to_numpy())
        count, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
        n_best, count_sum = [], []
        for at, n in zip(texts["pairs"].to_pylist(), texts["counts"].to_pylist(), strict=True):
            at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32).astype(np.int64)
            n_best.append(int(n[best[at]].sum()) if len(at) else 0)
            count_sum.append(int((n * count[at]).sum()) if len(at) else 0)
        return pa.Table.from_arrays([*(texts[f].combine_chunks() for f in FIELDS), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], schema=schema)

    with Scratch(docs.sparkSession) as kept:
        gathered = kept.stored(_gather(docs, path_a, path_b))
        listed = kept.stored(_listed(gathered))
        looked = listed.select("chunk", "pair").join(kept.stored(pair_counts(listed)), "pair")
        texts = gathered.where("NOT is_chunk").select("chunk", *FIELDS, "pairs", "counts")
        return stored(texts.groupBy("chunk").cogroup(looked.groupBy("chunk")).applyInArrow(look_up, ddl(OUT)))


def links(docs: DataFrame, kind: str = "overlap", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """All links of ``docs`` as rows: doc_id, number and id of the A token and of the B token, weight.

    kind: overlap (weight: shared bytes), end (ending together) or group (of the same group). Groups that both tokenizers cut into
    many tokens have as many links as their product; the rows are made unit by unit and never held together.
    """
    path_a, path_b = path_a or vocabulary("byte_bpe_50k.json"), path_b or vocabulary("piece_bpe_32k.model")
    fields = {"doc_id": "bigint", "a": "bigint", "b": "bigint", "id_a": "bigint", "id_b": "bigint", "weight": "bigint"}

    def fn(c):
        pair = load(path_a, path_b)
        for doc_id, text in zip(c["doc_id"], c["text"], strict=True):
            units = pair.units(text) if text else []
            if not units or None in pair.aligned(units):
                continue
            at_a = at_b = 0
            for unit in units:
                ids_a, ids_b, _ = pair.encoded([unit])
                ends_a, ends_b = np.cumsum(pair.sizes_a[ids_a]), np.cumsum(pair.sizes_b[ids_b])
                x, y, w = shared_group_links(ends_a, ends_b) if kind == "group" else overlap_links(ends_a, ends_b)
                if kind == "end":
                    x, y, w = (v[ends_a[x] == ends_b[y]] for v in (x, y, w))
                yield {"doc_id": [doc_id] * len(x), "a": (x + at_a).tolist(), "b": (y + at_b).tolist(), "id_a": ids_a[x].tolist(), "id_b": ids_b[y].tolist(), "weight": w.tolist()}
                at_a, at_b = at_a + len(ids_a), at_b + len(ids_b)

    return over_batches(docs.select("doc_id", "text"), fields, fn)
