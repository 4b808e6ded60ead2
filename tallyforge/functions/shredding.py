"""JSON texts as typed columns and a rest: what their paths hold is found in one pass.

Outside what the reference describes: a general addition.
"""

import json
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {int: "long", float: "double", bool: "boolean", str: "string"}
#: Paths that a task counts at once; beyond it sends what it has.
TASK_PATHS = 100_000


class _Unshreddable(ValueError):
    """A text whose value couldn't be put together again as it was."""


def _object(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Unshreddable("a key twice")
    return out


def _constant(name: str):
    raise _Unshreddable(name)


def _number(text: str) -> float:
    out = float(text)
    if out in (float("inf"), float("-inf")):
        raise _Unshreddable(text)
    return out


def parsed(text: str | None):
    """The object of a JSON text; None for all that isn't one object or wouldn't come back: no JSON, a key twice, numbers beyond doubles."""
    if text is None:
        return None
    try:
        out = json.loads(text, object_pairs_hook=_object, parse_constant=_constant, parse_float=_number)
        if "\\u" in text:
            json.dumps(out, ensure_ascii=False).encode()  # half a pair of surrogates is no text
    except (ValueError, RecursionError):
        return None
    return out if isinstance(out, dict) else None


def name_of(path: tuple[str, ...]) -> str:
    """A path as a column's name: keys joined by dots, with dots and backslashes of keys escaped."""
    return ".".join(k.replace("\\", "\\\\").replace(".", "\\.") for k in path)


def path_of(name: str) -> tuple[str, ...]:
    out, key, escaped = [], "", False
    for c in name:
        if escaped or c not in "\\.":
            key, escaped = key + c, False
        elif c == "\\":
            escaped = True
        else:
            out.append(key)
            key = ""
    return (*out, key)


def leaves(value: dict, path: tuple[str, ...] = ()):
    """(path, kind, value) of the scalars in an object that a column can hold; others have no kind."""
    for k, v in value.items():
        if isinstance(v, dict) and v:
            yield from leaves(v, (*path, k))
        else:
            kind = KINDS.get(type(v))
            yield (*path, k), None if kind == "long" and not -(2**63) <= v < 2**63 else kind, v


def paths(df: DataFrame, column: str) -> DataFrame:
    """(path, kind, rows): how many rows have a scalar of each kind at each path. Tasks count on their own, and counts are summed."""

    def run(frames):
        seen: Counter = Counter()
        for f in frames:
            for text in f["text"]:
                for path, kind, _ in leaves(parsed(text) or {}):
                    if kind:
                        seen[name_of(path), kind] += 1
            if len(seen) > TASK_PATHS:
                yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "kind", "rows"])
                seen = Counter()
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["path", "kind", "rows"]).astype({"rows": "int64"})

    counted = df.select(F.col(column).alias("text")).mapInPandas(run, "path string, kind string, rows long")
    return counted.groupBy("path", "kind").agg(F.sum("rows").alias("rows"))


def plan(df: DataFrame, column: str, columns: int = 100, share: float = 0.01) -> list[tuple[str, str]]:
    """(path, kind) of the columns worth having: for each path the kind that most rows have, where that is at least ``share`` of all, the most frequent ``columns``.

    Only these come to the driver. A path that is also the way to others, or differs from another only in case, may be among them.
    """
    total = df.select(F.count(F.lit(1))).first()[0]
    best = paths(df, column).groupBy("path").agg(F.max(F.struct("rows", "kind")).alias("best"))
    rows = best.where(F.col("best.rows") >= F.lit(total * share)).orderBy(F.desc("best.rows"), "path").limit(columns).select("path", "best.kind").collect()
    return sorted((r["path"], r["kind"]) for r in rows)


def _without(value: dict, taken: set, path: tuple[str, ...] = ()) -> dict:
    out = {}
    for k, v in value.items():
        own = (*path, k)
        if own in taken:
            continue
        if isinstance(v, dict) and v:
            v = _without(v, taken, own)
            if not v:
                continue
        out[k] = v
    return out


def shred(df: DataFrame, column: str, chosen: list[tuple[str, str]], prefix: str = "", rest: str = "rest") -> DataFrame:
    """``df`` with a struct ``prefix or column`` replaced: its other columns, a typed column for each chosen path, and ``rest``.

    What a column can't hold stays in the rest, as JSON: other paths, values of another kind than the column's, nulls that are written out, arrays,
    empty objects, numbers beyond 64 bits. A text that isn't one JSON object, or has a key twice, stays in the rest as it is. A row whose values all
    went to columns has no rest; a null text gives nulls only. ``unshred`` gives back equal values; the order of keys may differ.
    """
    fields = ", ".join(f"`c{i}` {kind}" for i, (_, kind) in enumerate(chosen))
    kinds = {path_of(p): (i, kind) for i, (p, kind) in enumerate(chosen)}

    def one(text):
        values: list = [None] * len(chosen)
        value = parsed(text)
        if value is None:
            return (*values, text)
        taken = set()
        for path, kind, v in leaves(value):
            if kind and kinds.get(path, (0, None))[1] == kind:
                values[kinds[path][0]] = v
                taken.add(path)
        left = _without(value, taken) if taken else value
        return (*values, json.dumps(left, ensure_ascii=False) if left or not taken else None)

    @F.pandas_udf(f"{fields}{', ' if fields else ''}rest string")
    def cut(texts: pd.Series) -> pd.DataFrame:
        rows = [one(t) for t in texts]
        frame = pd.DataFrame({f"c{i}": pd.array([r[i] for r in rows], dtype={"long": "Int64", "double": "Float64", "boolean": "boolean", "string": "object"}[k]) for i, (_, k) in enumerate(chosen)}, index=range(len(rows)))
        frame["rest"] = [r[-1] for r in rows]
        return frame

    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [quoted(c) for c in df.columns if c != column]
    made = df.select(*others, cut(quoted(column)).alias("__cut"))
    return made.select(*others, *(F.col(f"__cut.c{i}").alias(prefix + p) for i, (p, _) in enumerate(chosen)), F.col("__cut.rest").alias(rest))


def unshred(columns: list[Column], chosen: list[tuple[str, str]], rest: Column) -> Column:
    """The JSON text of typed columns, in the order of ``chosen``, and a rest."""
    ways = [path_of(p) for p, _ in chosen]

    @F.pandas_udf("string")
    def joined(typed: pd.Series, rests: pd.Series) -> pd.Series:
        out = []
        for own, text in zip(map(json.loads, typed), rests, strict=True):
            if own:
                value = json.loads(text) if isinstance(text, str) else {}
                for name, v in own.items():
                    at = value
                    for k in ways[int(name)][:-1]:
                        at = at.setdefault(k, {})
                    at[ways[int(name)][-1]] = v
                text = json.dumps(value, ensure_ascii=False)
            out.append(text)
        return pd.Series(out, dtype="object")

    # as JSON, since pandas would turn whole numbers with nulls into doubles; a null column isn't in it
    return joined(F.to_json(F.struct(*(c.alias(str(i)) for i, c in enumerate(columns)))) if columns else F.lit("{}"), rest)
