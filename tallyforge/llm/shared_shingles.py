"""Which shingles several sets hold, by values only: sets stay where they are until they can link.

A task numbers its sets and settles what it can by itself: a shingle that two of its sets hold is
shared. Of every distinct shingle it sends the value and the set's number (two bytes) to the
value's range, or one mark for a settled one, so a shingle that a third of all sets hold reaches
its range once a batch. Ranges answer batch by batch, with the numbers of the sets whose shingles others hold too; the
batch's directory, which says what the numbers stand for, goes to the answers directly. Nothing in it grows
with the number of ranges but the rows' own overhead.

Batches are numbered by partition, so a task that runs again sends the same.
"""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tallyforge.llm.common import arrow_schema, ddl, over_batches

#: Shingles and sets of a batch, and shingles of a range.
BATCH_SHINGLES = 1_000_000
BATCH_SETS = 60_000
RANGE_SHINGLES = 1_000_000
#: Stands for the sets of a batch that a settled shingle has.
MARK = 0xFFFF
#: The largest frequency that is told apart.
MOST = 255
_ODD = np.uint64(0x9E3779B97F4A7C15)

CELL = {"part": "int", "batch": "bigint", "owners": "binary", "shingles": "binary", "counts": "binary", "directory": "binary"}
ANSWER = {k: v for k, v in CELL.items() if k != "part"}


def heads(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def dealt(rows: DataFrame, of: Callable, ranges: int) -> DataFrame:
    """Rows of CELL. ``of`` takes a batch of ``rows`` and yields (tuple of longs that stand for a set, its sorted shingles)."""

    batches = [0]  # of this task

    def flush(held):
        batch = TaskContext.get().partitionId() << 32 | batches[0]
        batches[0] += 1
        sizes = np.fromiter((len(s) for _, s in held), np.int64, len(held))
        flat, owner = np.concatenate([s for _, s in held]), np.repeat(np.arange(len(held)), sizes).astype(np.uint16)
        order = np.argsort(flat)
        flat, owner = flat[order], owner[order]
        head = np.flatnonzero(heads(flat))
        length = np.diff(np.r_[head, len(flat)])
        settled = np.repeat(length > 1, length)
        record = np.array([r for r, _ in held], np.int64)
        out = {k: [] for k in CELL}

        def add(*row):
            for name, v in zip(CELL, row, strict=True):
                out[name].append(v)

        add(ranges + batch % ranges, batch, owner[settled].tobytes(), flat[settled].tobytes(), b"", record.tobytes())
        value, who = flat[head], np.where(length > 1, MARK, owner[head]).astype(np.uint16)
        part = (((value * _ODD) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        value, who, length, edge = value[order], who[order], length[order], np.searchsorted(part[order], np.arange(ranges + 1))
        for p in np.flatnonzero(np.diff(edge)).tolist():
            i, j = edge[p], edge[p + 1]
            marked = who[i:j] == MARK
            add(p, batch, who[i:j].tobytes(), value[i:j].tobytes(), np.minimum(length[i:j][marked], MOST).astype(np.uint8).tobytes(), None)
        return out

    def fn(c):
        held, n = [], 0
        for record, s in of(c):
            held.append((record, s))
            n += len(s)
            if n > BATCH_SHINGLES or len(held) == BATCH_SETS:
                yield flush(held)
                held, n = [], 0
        if held:
            yield flush(held)

    return over_batches(rows, CELL, fn)


def answered(cells: DataFrame, ranges: int, values: bool) -> DataFrame:
    """Rows of ANSWER: directories as they came, and each batch's shingles that others hold; with ``values``, what and how frequent they are, marks too."""
    schema = arrow_schema(ANSWER)

    def fn(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() >= ranges:
            return table.select(list(ANSWER)).cast(schema)
        rows = [table.column(k).to_pylist() for k in ("owners", "shingles", "counts")]
        owner, flat, counts = (np.frombuffer(b"".join(r), kind) for r, kind in zip(rows, (np.uint16, np.uint64, np.uint8), strict=True))
        row = np.repeat(np.arange(len(table)), [len(o) // 2 for o in rows[0]])
        marked, weight = owner == MARK, np.ones(len(flat), np.int64)
        weight[marked] = counts
        order = np.argsort(flat)
        head = np.flatnonzero(heads(flat[order]))
        length = np.diff(np.r_[head, len(flat)])
        told = np.zeros(len(flat), bool)
        told[order] = np.repeat(length > 1, length)
        told = told | marked if values else told & ~marked
        frequency = np.zeros(len(flat), np.uint8)
        if len(flat):
            frequency[order] = np.repeat(np.minimum(np.add.reduceat(weight[order], head), MOST), length).astype(np.uint8)
        told = np.flatnonzero(told)
        edge = np.searchsorted(row[told], np.arange(len(table) + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        own = [told[edge[i] : edge[i + 1]] for i in some]
        out = {
            "batch": table.column("batch").combine_chunks().take(pa.array(some, pa.int64())),
            "owners": [owner[x].tobytes() for x in own],
            "shingles": [flat[x].tobytes() if values else None for x in own],
            "counts": [frequency[x].tobytes() if values else None for x in own],
            "directory": [None] * len(own),
        }
        return pa.Table.from_pydict(out, schema=schema)

    return cells.groupBy("part").applyInArrow(fn, ddl(ANSWER))


def _joined(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x or b"" for x in table.column(name).to_pylist()), kind)


def directory(table: pa.Table, width: int) -> tuple[np.ndarray, pa.Table, pa.Table]:
    """Of all answers to a batch: its sets' records of ``width`` longs, the row with what the batch settled, and the ranges' answers."""
    own = table.column("directory").is_valid()
    return _joined(table, "directory", np.int64).reshape(-1, width), table.filter(own), table.filter(pa.compute.invert(own))


def by_batch(answers: DataFrame, fields: dict[str, str], fn: Callable[[pa.Table], dict]) -> DataFrame:
    """``fn`` over all answers to each batch, giving columns of ``fields``."""
    schema = arrow_schema(fields)
    return answers.groupBy("batch").applyInArrow(lambda table: pa.Table.from_pydict(fn(table), schema=schema), ddl(fields))


def counted(table: pa.Table, sets: int) -> np.ndarray:
    """How many shingles of each set others hold."""
    return np.bincount(_joined(table, "owners", np.uint16), minlength=sets)


def held(settled: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's occurrences of shared shingles: set, shingle and frequency."""
    owner, flat, frequency = _joined(told, "owners", np.uint16), _joined(told, "shingles", np.uint64), _joined(told, "counts", np.uint8)
    marked = owner == MARK
    order = np.argsort(flat[marked])
    value, often = flat[marked][order], frequency[marked][order]
    own, local = _joined(settled, "owners", np.uint16), _joined(settled, "shingles", np.uint64)
    of_local = often[np.searchsorted(value, local)] if len(local) else np.zeros(0, np.uint8)
    return np.r_[owner[~marked], own].astype(np.int64), np.r_[flat[~marked], local], np.r_[frequency[~marked], of_local]
