"""Quantile sketches as stored state: compactors that know the bound of their own rank error.

Outside what the reference describes: a general addition.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that a level keeps before it is compacted.
SIZE = 512
#: A sketch with more levels than these keeps as many times more values in each.
DEEP = 8
#: Values that a task holds in open sketches, over all groups; beyond it sends what it has.
TASK_VALUES = 2_000_000
#: Sketches of a group are merged in rounds over so many buckets, so that no task gathers those of all tasks.
ROUNDS = (4096, 64, 1)


class Compactor:
    """Values by level, one at level h standing for 2**h; ``n`` values in all.

    A level that is full is sorted and every second value moves up. From the first on, the rank of a given value can only grow, by 2**h at most;
    from the second on it can only shrink, by as much. ``over`` and ``under`` sum the two, each compaction takes the way that leaves
    the larger sum smaller, and the larger is the bound of every rank's ``error``: about half of all that compactions may move. When values come one by one,
    error <= n / size * (log2(n / size) + 1) / 2 or so up to ``DEEP`` levels, and as deeper sketches have larger levels, from there on
    it stays below a fixed part of ``n``, however large that is; in batches fewer compactions are needed.
    """

    def __init__(self, size: int = SIZE):
        self.size, self.n, self.over, self.under = size, 0, 0, 0
        self.levels: list[np.ndarray] = []

    @property
    def error(self) -> int:
        return max(self.over, self.under)

    def _compact(self) -> None:
        h = 0
        while h < len(self.levels):
            values = self.levels[h]
            if len(values) > self.size * max(len(self.levels), DEEP) // DEEP:
                values = np.sort(values)
                even = len(values) // 2 * 2
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                first = 0 if self.over <= self.under else 1
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[first:even:2]])
                self.levels[h] = values[even:]
                if first:
                    self.under += 1 << h
                else:
                    self.over += 1 << h
            h += 1

    def add(self, values: np.ndarray) -> None:
        values = np.asarray(values, float)
        values = values[~np.isnan(values)]
        if len(values):
            self.n += len(values)
            self.levels = self.levels or [np.zeros(0)]
            self.levels[0] = np.concatenate([self.levels[0], values])
            self._compact()

    def merge(self, other: "Compactor") -> None:
        self.n, self.over, self.under = self.n + other.n, self.over + other.over, self.under + other.under
        for h, values in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = np.concatenate([self.levels[h], values])
        self._compact()

    def held(self) -> int:
        return sum(map(len, self.levels))

    def weighted(self) -> tuple[np.ndarray, np.ndarray]:
        """The values in order, and the estimated number of values up to each."""
        values = np.concatenate([np.zeros(0), *self.levels])
        weights = np.concatenate([np.zeros(0, np.int64), *(np.full(len(v), 1 << h) for h, v in enumerate(self.levels))])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def quantiles(self, fractions: list[float]) -> list[float | None]:
        """Of each fraction the least value with at least so many values up to it; its rank is off by ``error`` at most."""
        values, upto = self.weighted()
        if not len(values):
            return [None] * len(fractions)
        at = np.searchsorted(upto, np.maximum(np.ceil(np.asarray(fractions) * self.n), 1))
        return values[np.minimum(at, len(values) - 1)].tolist()

    def to_bytes(self) -> bytes:
        head = np.array([2, self.size, self.n, self.over, self.under, len(self.levels), *map(len, self.levels)], "<i8")
        return head.tobytes() + b"".join(v.astype("<f8").tobytes() for v in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> "Compactor":
        version, size, n, over, under, depth = np.frombuffer(raw, "<i8", 6).tolist()
        if version not in (1, 2):
            raise ValueError(f"unknown version of a sketch: {version}")
        out = cls(size)
        # the first version had one sum for both ways, and a number of turns
        out.n, out.over, out.under = n, over, over if version == 1 else under
        lengths = np.frombuffer(raw, "<i8", depth, 48).tolist()
        at = 48 + 8 * depth
        for m in lengths:
            out.levels.append(np.frombuffer(raw, "<f8", m, at).copy())
            at += 8 * m
        return out


def _fields(df: DataFrame, by: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in by)


def quantile_sketches(df: DataFrame, value: str, by: list[str] = (), size: int = SIZE) -> DataFrame:
    """(by, n, error, sketch): a sketch for each group, of its values that aren't null or NaN; groups without any are left out.

    Each task sketches its own rows, and sketches are merged in rounds: only they are shuffled. A null in ``by`` is a group
    as any other; an empty table has no sketches.
    """
    by = list(by)

    def run(frames):
        open_: dict[tuple, Compactor] = {}
        held = 0

        def sent():
            return pd.DataFrame([(*k, s.n, s.error, bytearray(s.to_bytes())) for k, s in open_.items()], columns=[*by, "n", "error", "sketch"]).astype({"n": "int64", "error": "int64"})

        for f in frames:
            groups = f.groupby(by, dropna=False, sort=False)["_value"] if by else [((), f["_value"])]
            for key, values in groups:
                key = tuple(None if pd.isna(v) else v for v in key)
                sketch = open_.setdefault(key, Compactor(size))
                held -= sketch.held()
                sketch.add(values.to_numpy(float, na_value=np.nan))
                held += sketch.held()
            if held > TASK_VALUES:
                yield sent()
                open_, held = {}, 0
        yield sent()

    rows = df.select(*by, F.col(value).cast("double").alias("_value")).where("_value IS NOT NULL AND NOT isnan(_value)")
    return merge_sketches(rows.mapInPandas(run, _fields(df, by) + "n long, error long, sketch binary").where("n > 0"), by)


def merge_sketches(sketches: DataFrame, by: list[str] = ()) -> DataFrame:
    """One sketch for each group of any number of them, as of tables of several runs; errors add up, and more where levels fill."""
    by = list(by)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        out = Compactor.from_bytes(bytes(frame["sketch"].iloc[0]))
        for raw in frame["sketch"].iloc[1:]:
            out.merge(Compactor.from_bytes(bytes(raw)))
        return pd.DataFrame([(*(frame[c].iloc[0] for c in by), frame["_bucket"].iloc[0], out.n, out.error, out.to_bytes())], columns=[*by, "_bucket", "n", "error", "sketch"])

    rows = sketches.select(*by, F.xxhash64("sketch").alias("_bucket"), "n", "error", "sketch")
    for buckets in ROUNDS:
        rows = rows.withColumn("_bucket", F.pmod("_bucket", F.lit(buckets))).groupBy(*by, "_bucket").applyInPandas(merged, _fields(sketches, by) + "_bucket long, n long, error long, sketch binary")
    return rows.drop("_bucket")


def quantiles(sketches: DataFrame, fractions: list[float], by: list[str] = ()) -> DataFrame:
    """(by, n, error, fraction, value): the estimates of each sketch."""
    by = list(by)

    def run(frames):
        for f in frames:
            rows = [(*(getattr(r, f"k{i}") for i in range(len(by))), r.n, r.error, q, v) for r in f.itertuples() for q, v in zip(fractions, Compactor.from_bytes(bytes(r.sketch)).quantiles(fractions), strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "n", "error", "fraction", "value"])

    keyed = sketches.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(by)), "n", "error", "sketch")
    return keyed.mapInPandas(run, _fields(sketches, by) + "n long, error long, fraction double, value double")
