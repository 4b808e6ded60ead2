"""Regions, cells and heads of the Jaccard join against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import jaccard_join, shared_shingles


def plain_groups(sets):
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return [root(i) for i in range(len(sets))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 14), min_size=1, max_size=12), min_size=1, max_size=40), st.booleans())
def test_regions_join_exactly(sets, labelled):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    n = np.array([len(s) for s in sets])
    want = plain_groups(sets)
    label = np.array([0 if g == want[0] else i + 1 for i, g in enumerate(want)]) if labelled else None
    label = None if label is None else np.unique(label, return_inverse=True)[1]
    probes = np.flatnonzero(label != label[0]) if labelled else None
    links = jaccard_join.Region(n, arrays, label).joined(probes)
    parent = list(range(len(sets)))

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in [*links, *((i, want[0]) for i, g in enumerate(want) if labelled and g == want[0])]:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert [root(i) for i in range(len(sets))] == want
    assert not labelled or all(want[x] == want[y] and x in probes for x, y in links)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 200), min_size=1, max_size=80), st.sets(st.integers(0, 200), max_size=20), st.floats(0, 0.25))
def test_heads_of_partners_share_enough(base, more, less):
    other = (base - set(sorted(base, key=lambda x: hash((x, 1)))[: int(less * len(base))])) | more
    both = len(base & other)
    if 100 * both < 75 * len(base | other):
        return
    heads = [set(jaccard_join.head(np.array(sorted(s), np.uint64)).tolist()) for s in (base, other)]
    for s in (base, other):
        assert len(heads[0] & heads[1]) >= jaccard_join.told(jaccard_join.needed(len(s)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "c", "d"]), max_size=40), st.integers(1, 5))
def test_words_are_hashed_once(text, k):
    """Sets are sorted and distinct, as many as the plain ones, and a worker hashes a word only when it is new."""
    known = jaccard_join._Words()
    assert len({known[w] for w in map(str.encode, text)}) == len(known) == len(set(text))
    words = [w.lower() for w in text]
    size = min(k, len(words))
    plain = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()
    found = jaccard_join.shingles(" ".join(text), k)
    assert len(found) == len(plain) and found.tolist() == sorted(set(found.tolist()))


@pytest.mark.parametrize("batch", [(1_000_000, 60_000), (40, 3)])
def test_shared_shingles_across_batches(spark, monkeypatch, batch):
    monkeypatch.setattr(shared_shingles, "BATCH_SHINGLES", batch[0])
    monkeypatch.setattr(shared_shingles, "BATCH_SETS", batch[1])
    r = random.Random(8)
    sets = [sorted({r.randrange(1 << 40) if r.random() < 0.5 else r.randrange(30) for _ in range(20)}) for _ in range(50)]
    rows = spark.createDataFrame(list(enumerate(sets)), "i long, s array<long>").repartition(3)

    def of(c):
        for i, s in zip(c["i"], c["s"], strict=True):
            yield (i,), np.array(s, np.uint64)

    def fn(table):
        record, settled, told = shared_shingles.directory(table, 1)
        owner, flat, frequency = shared_shingles.held(settled, told)
        return {"i": record[owner, 0], "s": flat.astype(np.int64), "f": frequency.astype(np.int64)}

    answers = shared_shingles.answered(shared_shingles.dealt(rows, of, 4), 4, True)
    got = sorted(tuple(x) for x in shared_shingles.by_batch(answers, {"i": "bigint", "s": "bigint", "f": "bigint"}, fn).collect())
    count = {x: sum(x in s for s in sets) for s in sets for x in s}
    assert got == sorted((i, x, count[x]) for i, s in enumerate(sets) for x in s if count[x] > 1)


def test_cells_of_large_regions(spark):
    """Families around several centres, some points between them, and small far ones: parted by pivots, several levels deep."""
    r = random.Random(6)
    fresh = lambda: f"w{r.randrange(10**8)}"
    shared = [fresh() for _ in range(40)]
    rows = []
    for _ in range(12):
        centre = shared + [fresh() for _ in range(60)]
        for _ in range(25):
            own = list(centre)
            for _ in range(r.randrange(0, 12)):
                own[r.randrange(len(own))] = centre[r.randrange(len(own))] if r.random() < 0.5 else fresh()
            rows.append(" ".join(own))
    few = [fresh() for _ in range(30)]
    rows += [" ".join(r.sample(few, 9)) for _ in range(150)]
    text = [t.split() for t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in text]
    want = plain_groups(sets)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    for size in (2_000, 10_000):
        got = {x["doc_id"]: x["component_id"] for x in jaccard_join.linked(docs, region_shingles=size).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_odd_inputs(spark):
    schema = "doc_id long, text string, `a.b` string, region long"
    rows = [(1, "one two three four five six", "x", 1), (1, "one two three four five six", "x", 1), (2, "ONE two three four five six", None, 2), (None, None, "y", None), (5, "", "z", 3), (6, "a " * 200_000, "z", 3)]
    docs = spark.createDataFrame(rows, schema)
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] or 0 for r in out.collect()) == [0, 1, 1, 5, 6]
    assert jaccard_join.linked(docs.limit(0)).count() == 0 and jaccard_join.one_of_each(docs.limit(0)).count() == 0
