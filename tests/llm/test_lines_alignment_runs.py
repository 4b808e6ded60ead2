"""Line dedup, cross-tokenizer alignment and periodic runs against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge.llm import alignment, line_dedup, oracles, periodic_runs, registry
from tallyforge.llm.packing import vocabulary

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_dedup(rows):
    """(n_lines, n_dropped, text) of each (doc_id, text)."""
    key = lambda line: line.strip(line_dedup.SPACE).translate(FOLD)
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    least = lambda i: (i is not None, i or 0)
    goes = lambda line, i: len(key(line)) >= 20 and len(holders[key(line)]) >= 3 and least(i) < max(map(least, holders[key(line)]))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not goes(x, i)]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left) if left else None))
    return out


@pytest.fixture(scope="module")
def lined():
    r = random.Random(3)
    pool = ["short", "a line of exactly 20", "A Line Of Exactly 20 ", "\t the same long line in many texts\x0b\r", "The same long line in MANY texts", "é" * 20, "É" * 20, "漢" * 19, "漢" * 20, "", "   ", "x" * 5000, "once more for all of them"]
    pool += [f"own line number {i} of the pool" for i in range(10)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 9)))) for i in range(60)]
    rows += [(7, rows[7][1]), (7, "once more for all of them\nand another"), (None, "once more for all of them\nx"), (None, rows[3][1]), (100, None), (101, ""), (102, "\n\n"), (103, "once more for all of them")]
    return rows


@pytest.mark.parametrize("hot_share", [1, 5, 1000])
def test_lines_are_dropped_as_plainly(spark, lined, hot_share):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in lined], "doc_id long, text string, h1 int, `line.a` string").repartition(4)
    got = line_dedup.deduplicated(docs, hot_share=hot_share).collect()
    assert Counter(map(tuple, got)) == Counter(plain_dedup(lined))


def test_lines_equal_sql(spark, duck):
    same(registry.op11_line_dedup(spark, SF).toPandas(), duck(oracles.OP11, SF))


def test_a_hot_line_reaches_many_tasks(spark):
    """A third of all lines are the same; without adaptive splitting no task of the joins makes most of the verdicts."""
    docs = spark.range(30_000, numPartitions=8).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'this line is in a third of all' ELSE concat('one of many other lines ', id % 5000) END AS text")
    lines = line_dedup.hashed_lines(docs)
    shared = line_dedup.shared_lines(lines)
    shared = spark.createDataFrame(shared.collect(), shared.schema)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = line_dedup.dropped_lines(lines, shared).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r[1] for r in tasks) == 30_000 - 1 - 5000 and max(r[1] for r in tasks) < 0.15 * 30_000


@pytest.fixture(scope="module")
def tokenizers_():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


def plain_alignment(tokenizers_, text):
    """(n_a, n_b, groups as text, end links) by the libraries on the whole text."""
    a, b = tokenizers_
    if not text:
        return 0, 0, "", []
    raw = (" " + text).encode()
    letters = alignment._bytes_of_letters()
    e = a.encode(" " + text, add_special_tokens=False)
    ids_a, ids_b = e.ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in t) for t in e.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, map(b.id_to_piece, ids_b), strict=True)]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return 0, 0, "", []
    ends_a, ends_b = (dict(zip(np.cumsum(list(map(len, x))).tolist(), range(len(x)), strict=True)) for x in (bytes_a, bytes_b))
    groups, links, i, j = [], [], 0, 0
    for e in sorted(ends_a.keys() & ends_b.keys()):
        x, y = ends_a[e] + 1, ends_b[e] + 1
        groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
        links.append((ids_a[x - 1], ids_b[y - 1]))
        i, j = x, y
    return len(ids_a), len(ids_b), ";".join(groups), links


def aligned(texts):
    for found in alignment.alignments(texts, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")):
        if found is None:
            yield 0, 0, "", []
        else:
            yield sum(found[0]), sum(found[1]), "".join(found[2])[:-1], [divmod(p, alignment.PAIR) for x in found[3] for p in x]


PARTS = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "the", " of", "ing", "é", "漢字", "😀", "'s", "'", "<|endoftext|>", "<s>", "123", ".", "!!", "==", "▁", "\r\n", "\r", ";\r", "Zeit", "́", "\x00", "<0x0A>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=5).filter(lambda t: not any("\ud800" <= c <= "\udfff" for c in t)), max_size=30).map("".join))
def test_alignment_of_odd_texts(tokenizers_, text):
    assert list(aligned([text, None, text + " x"])) == [plain_alignment(tokenizers_, t) for t in (text, None, text + " x")]


def test_alignment_over_the_corpus(spark, tokenizers_, docs, monkeypatch):
    """All columns against the libraries; chunks of any size give the same."""
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True).repartition(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    plain = [plain_alignment(tokenizers_, t) for _, t in rows]
    count = Counter(p for *_, links in plain for p in links)
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    expected = Counter()
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, plain, strict=True):
        best = sum(count[p] == highest[p[1]] for p in links)
        expected[(doc_id, n_a, n_b, len(links), len(links), sha(groups) if links else "", best, sum(count[p] for p in links))] += 1
    assert Counter(map(tuple, alignment.align(docs).collect())) == expected
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 50)
    assert Counter(map(tuple, alignment.align(docs).collect())) == expected


def test_products_are_the_dense_ones():
    r = np.random.default_rng(4)
    for _ in range(50):
        dense_a, dense_b = r.random((7, 9)) < 0.3, r.random((9, 6)) < 0.3
        rows = lambda m: alignment.Rows(np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
        x, y, w = alignment.row_product(rows(dense_a), rows(dense_b))
        out = np.zeros((7, 6), int)
        out[x, y] = w
        assert (out == dense_a.astype(int) @ dense_b.astype(int)).all() and len(x) == (out > 0).sum()
        back = rows(dense_a).transposed(9)
        assert (back.indptr == rows(dense_a.T).indptr).all()


def test_links_by_kind(spark, tokenizers_):
    docs = spark.createDataFrame([(1, "unbelievable things, naïve 漢字"), (2, None), (3, "▁"), (None, "a")], "doc_id long, text string")
    rows = {k: [tuple(r) for r in alignment.links(docs, k).collect()] for k in ("overlap", "end", "group")}
    n_a, n_b, groups, ends = plain_alignment(tokenizers_, "unbelievable things, naïve 漢字")
    assert [(r[3], r[4]) for r in rows["end"] if r[0] == 1] == ends
    assert len([r for r in rows["overlap"] if r[0] == 1]) == n_a + n_b - len(ends)
    assert sum(r[5] for r in rows["overlap"] if r[0] == 1) == len(" unbelievable things, naïve 漢字".encode())
    assert len([r for r in rows["group"] if r[0] == 1]) == sum(len(x.split(",")) * len(y.split(",")) for x, y in (g.split("|") for g in groups.split(";")))
    assert {r[0] for r in rows["end"]} == {1, None}


def plain_runs(w):
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


PIECE = st.lists(st.sampled_from("abc"), min_size=1, max_size=25) | st.lists(st.integers(0, 500).map(str), min_size=1, max_size=70)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.tuples(PIECE, st.integers(1, 6), st.integers(0, 9)), max_size=6), max_size=4))
def test_runs_of_repeated_pieces(parts):
    texts = [[w for piece, times, cut in t for w in (piece * times)[: len(piece) * times - cut % len(piece)]] for t in parts]
    for words, (runs, kept) in zip(texts, periodic_runs.found(texts), strict=True):
        assert runs == plain_runs(words)
        covered = {i for s, m, q in runs for i in range(s + q, s + m)}
        assert kept == [w for i, w in enumerate(words) if i not in covered]


def test_long_runs_at_many_scales():
    r = random.Random(8)
    for p in (15, 16, 17, 31, 64, 100, 257, 1000):
        piece = [str(r.randrange(50)) for _ in range(p)]
        words = [str(r.randrange(50)) for _ in range(99)] + (piece * 5)[: 4 * p + 3] + ["end"] + ["x"] * 3000 + piece
        assert list(periodic_runs.found([words, words[::-1]]))[0][0] == plain_runs(words)


def test_the_transform_convolves_exactly():
    r = np.random.default_rng(1)
    for size in (2, 8, 64, 512):
        a, b = r.integers(0, 1000, (3, size)), r.integers(0, 1000, (3, size))
        product = periodic_runs.transform(periodic_runs.transform(a) * periodic_runs.transform(b) % np.uint64(periodic_runs.PRIME), inverse=True)
        plain = [[sum(int(x[i]) * int(y[(k - i) % size]) for i in range(size)) for k in range(size)] for x, y in zip(a, b, strict=True)] if size < 100 else None
        assert plain is None or product.tolist() == plain
        assert (periodic_runs.transform(periodic_runs.transform(a), inverse=True) == a).all()


def test_zero_distances_are_all_found():
    r = np.random.default_rng(2)
    for scale in (16, 32):
        x = np.concatenate([np.tile(r.integers(0, 3, 20), 12), r.integers(0, 2, 200), np.tile(r.integers(0, 50, 45), 6)])
        blocks = np.arange((len(x) - 3 * scale) // scale)
        got = set(zip(*(v.tolist() for v in periodic_runs.zero_distances(x, blocks, scale)), strict=True))
        assert got == {(b, d) for b in blocks.tolist() for d in range(scale, 2 * scale) if (x[b * scale : (b + 1) * scale] == x[b * scale + d : (b + 1) * scale + d]).all()}


def test_run_digests(spark, docs):
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), allowMissingColumns=True).repartition(3)
    expected = Counter()
    for r in docs.select("doc_id", "text").collect():
        w = periodic_runs.WORD.findall(r["text"] or "")
        h = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
        if h is not None and h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = plain_runs(w)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        covered = {i for s, m, q in runs for i in range(s + q, s + m)}
        row = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        expected[(r["doc_id"], len(w), len(runs), *row, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in covered)))] += 1
    assert Counter(map(tuple, periodic_runs.digests(docs).collect())) == expected
    assert periodic_runs.runs(docs).count() == sum(r[2] * n for r, n in expected.items())
