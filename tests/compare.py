"""Comparison of results."""

import pandas as pd


def same(a, b):
    """Both frames hold the same rows, whatever their order."""
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda f: sorted(map(repr, ([None if pd.isna(v) else float(v) if not isinstance(v, (str, bool)) else v for v in r] for r in f[sorted(f.columns)].astype(object).values.tolist())))
    assert key(a) == key(b)
