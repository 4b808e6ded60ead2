"""URL filters, sharding, media, the Jaccard join, repeated passages and the pipeline against plain versions."""

import hashlib
import random
import re
import string
import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import bwt_merge, gif_media, jaccard_join, kd_sharding, repeated_bytes, url_filters
from tallyforge.llm.common import Scratch, joined_with_groups
from tallyforge.llm.components import components
from tallyforge.llm.registry import RULES


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/1?x", "http://example.net/de/", "http://badexample.com/de/1", "http://x.example.com/de/1", "http://example.com#/de/", "s://org/fr/", "s://a.org/fr", "s://É.Net", "s://a://b/c", "s://h\n/p\nq?"]
    rows = [(i, u, None) for i, u in enumerate(urls)] + [(99, urls[4], 1)] * 2
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), RULES).collect()
    assert len(out) == len(rows)
    for r in out:
        url = urls[4] if r["page_id"] == 99 else urls[r["page_id"]]
        host, path = plain_url(url)
        fits = [(len(rule), rule, v) for rule, v in RULES for d, _, p in [rule.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
        assert (r["host"], r["path"]) == (host, path)
        assert r["rule"] == (max(fits)[1] if fits else None) and (not fits or r["verdict"] == max(fits)[2])


def test_templates(spark):
    rows = [(f"http://h.com/a/{i}", 1) for i in range(60)] + [(f"http://h.com/b/{i}", 0) for i in range(60)] + [(f"http://h.com/c/{i}", 0) for i in range(60)]
    rows += [(f"http://h.com/u/name{chr(97 + i % 26)}{chr(97 + i // 26)}/x", None) for i in range(100)] + [("http://h.com/1/2/3/4/5/6/7/8", None)]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, bad int")
    out = {r["page_id"]: r for r in url_filters.judge(pages, []).collect()}
    assert out[0]["template"] == "/a/#" and out[0]["verdict"] == "block" and out[60]["verdict"] == "allow"
    assert len({out[i]["template"] for i in range(180, 280)}) == 1 and "*" in out[180]["template"] and out[280]["template"].endswith("/**")
    assert url_filters.judge(pages.limit(0), []).count() == 0


@pytest.mark.parametrize("heavy", [2000, 20_000])
def test_large_sections_do_not_vanish_among_small_ones(spark, heavy):
    name = F.translate(F.format_string("%04d", F.col("id") % 1000), string.digits, "abcdefghij")
    small = spark.range(5000).select(F.concat(F.lit("http://h.com/f"), name, F.lit("/x")).alias("url"), F.lit(0).alias("bad"))
    large = spark.range(heavy).select(F.lit("http://h.com/large/x").alias("url"), F.lit(1).alias("bad"))
    calm = spark.range(500).select(F.lit("http://h.com/calm/x").alias("url"), F.lit(0).alias("bad"))
    some = spark.range(40).select(F.lit("http://h.com/some/x").alias("url"), F.lit(1).alias("bad"))  # few pages, all bad
    new = spark.range(40).select(F.lit("http://h.com/new/x").alias("url"), F.lit(None).cast("int").alias("bad"))
    pages = small.union(large).union(calm).union(some).union(new).select(F.lit(1).alias("page_id"), "url", "bad")
    out = {r["path"]: r for r in url_filters.judge(pages, []).dropDuplicates(["path"]).collect()}
    assert {p for p, r in out.items() if r["verdict"] == "block"} == {"/large/x", "/some/x"} and len(out) == 1004
    assert out["/large/x"]["template"].startswith("/large/") and {r["template"] for p, r in out.items() if p[1] == "f" or p == "/new/x"} == {"/*/x"}


def test_branches_that_part_at_any_depth(spark):
    ends = [("seven.com/a/b/c/d/e/f/bad/x", 1), ("seven.com/a/b/c/d/e/f/good/x", 0), ("far.com" + "/s" * 40 + "/bad", 1), ("far.com" + "/s" * 40 + "/good", 0)]
    ends += [("two.com/a/b/c/d/e/f/x/u", 1), ("two.com/a/b/c/d/e/f/y/x", 0), ("two.com/a/b/c/d/e/f/y/z", 1), ("two.com/a/b/c/d/e/f/new/z", None)]
    rows = [(i, f"http://{u}", bad) for u, bad in ends for i in range(60)]
    out = url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, bad int"), []).dropDuplicates(["host", "path"]).collect()
    got = {r["host"] + r["path"]: r for r in out}
    assert all(got[u]["verdict"] == ("block" if bad else "allow") for u, bad in ends if bad is not None)
    assert len({got[u]["template"] for u, _ in ends if u.startswith("two")}) == 4


def test_shards(docs, spark, texts):
    out = kd_sharding.shard(docs, 4).toPandas()
    assert len(out) == len(texts) + 2 and set(out["shard"]) <= set(range(4))
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    one = out[out.doc_id.isin([8, 9, 10]) | out.doc_id.isna()]
    assert one["shard"].nunique() == 1
    sizes = out.drop_duplicates().set_index("doc_id")
    assert sizes.loc[0, "size"] == 1 and sizes.loc[0, "text_crc32"] == 0 and sizes.loc[7, "text_crc32"] == zlib.crc32(texts[7].encode())
    assert kd_sharding.shard(docs.limit(0), 4).count() == 0


def test_shards_are_near_equal(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for n in (8, 3):
        bytes_ = kd_sharding.shard(docs, n).groupBy("shard").sum("size").toPandas()["sum(size)"]
        assert len(bytes_) == n and bytes_.max() < 1.05 * bytes_.min()
    target = kd_sharding.shard(docs, target_bytes=400_000).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(target) == 7 and target.max() < 1.1 * 400_000


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 40))
def test_gif_round_trip(data, times):
    _, payload = gif_media.payload_of((data * times).decode("latin-1"))
    assert b"".join(f[0] for f in gif_media.decode_gif(gif_media.encode_bytes(payload))) == payload


def test_gif_long_and_random():
    raw = random.Random(1).randbytes(64 * 1024 * 3 + 64)
    frames = list(gif_media.decode_gif(gif_media.encode_bytes(raw)))
    assert b"".join(f[0] for f in frames) == raw and len(frames) == 4 and all(f[2] == gif_media.DELAY for f in frames)


def gif(frames, palette, size=(2, 2)):
    """A GIF by hand: frames of (left, top, w, h, disposal, transparent, flags, samples), 9-bit literal codes."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0xF7, 0, 0) + palette.ljust(768, b"\0")
    for left, top, w, h, disposal, clear, flags, samples in frames:
        bits = "".join(format(c, "09b")[::-1] for c in [256, *samples, 257])
        stream = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 7, clear or 0, 0)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + b"\x08" + bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def test_gif_disposal_and_transparency():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0])
    data = gif([(0, 0, 2, 2, 1, None, 0, [1, 1, 1, 1]), (0, 0, 1, 1, 3, None, 0, [2]), (1, 1, 1, 1, 2, None, 0, [2]), (0, 0, 2, 1, 1, 2, 0, [2, 0])], palette)
    shown = [f[1][..., :3].tolist() for f in gif_media.decode_gif(data)]
    r, g, k = [255, 0, 0], [0, 255, 0], [0, 0, 0]
    assert shown[0] == [[r, r], [r, r]] and shown[1] == [[g, r], [r, r]] and shown[2] == [[r, r], [r, g]] and shown[3] == [[r, k], [r, k]]
    last = list(gif_media.decode_gif(data))[3]
    assert last[1][1, 1, 3] == 0 and last[2] == 7 and gif_media.histogram(last[1]).sum(1).tolist() == [3, 3, 3]


def test_gif_interlaced_and_broken():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7]
    data = gif([(0, 0, 1, 9, 0, None, 0x40, rows)], bytes(range(30)), (1, 9))
    assert next(gif_media.decode_gif(data))[1][:, 0, 0].tolist() == [3 * i for i in range(9)]
    assert list(gif_media.decode_gif(b"")) == list(gif_media.decode_gif(b"PNG")) == []
    whole = gif_media.encode_bytes(bytes(range(64)))
    assert next(gif_media.decode_gif(whole[:-30]))[0][:8] == bytes(range(8))


def test_histograms_by_palette_are_those_of_the_canvas():
    r = random.Random(4)
    palette = bytes(r.randrange(256) for _ in range(12))
    some = lambda n: [r.randrange(4) for _ in range(n)]
    shown = [(0, 0, 3, 3, d, None, 0, some(9)) for d in (0, 2, 3)] + [(0, 0, 3, 3, 1, 2, 0, some(9)), (1, 0, 2, 3, 2, None, 0, some(6)), (0, 0, 2, 2, 3, None, 0, some(4)), (0, 0, 3, 3, 1, None, 0, some(9))]
    data = gif(shown, palette, (3, 3))
    got = [bins.tolist() for *_, bins in gif_media._decoded(data)]
    assert got == [gif_media.histogram(f[1]).tolist() for f in gif_media.decode_gif(data)] and len(got) == 7


def test_gif_frames_in_the_digests(spark):
    text = "ab" * 50_000
    out = gif_media.digests(gif_media.texts_as_gifs(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"))).collect()
    one, two = sorted(out, key=lambda x: x["doc_id"])
    frames = [f.split(":") for f in one["frame_features"].split("|")]
    bins = np.array([[[int(v) for v in c.split(",")] for c in f.split(";")] for _, f in frames])
    assert one["n_frames"] == 2 and [f[0] for f in frames] == ["4", "4"] and bins.sum((1, 2)).tolist() == [3 * 65536] * 2  # a frame as shown is the whole canvas
    assert [",".join(map(str, c)) for c in bins.sum(0).tolist()] == one["feature"].split(";") and two["frame_features"].startswith("4:64,0,")


def test_keys_of_many_rows_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.createDataFrame([(0 if i % 3 == 0 else i, i) for i in range(6000)], "k long, v long").repartition(4)
        groups = rows.where("k % 7 != 1").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("v").alias("m"))
        for how in ("inner", "left"):
            out = joined_with_groups(rows, groups, ["k"], "n", how, 64)
            got = out.withColumn("part", F.spark_partition_id()).collect()
            want = {(x["k"], x["v"], x["m"]) for x in rows.join(groups.drop("n"), "k", how).collect()}
            assert {(x["k"], x["v"], x["m"]) for x in got} == want and len(got) == len(want)
            assert len({x["part"] for x in got if x["k"] == 0}) == 8
        assert joined_with_groups(rows.limit(0), groups.limit(0), ["k"], "n").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_labels_by_the_number_in_the_path(spark):
    urls = [None, "x", *(f"http://a.net/{p}" for p in ("", "p", "2024/7", "2024/8", "7/x", "8-z", "p/8", "99999999999999999999/1"))] + ["http://a.net/2024/"] * 40
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(7, 0, 0), (8, 1, 1), (8, 1, 0), (9, 1, 0), (-5, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {x["page_id"]: x["bad"] for x in url_filters.labelled_pages(pages, labels).collect()}
    number = [re.search("/([0-9]+)", re.sub(r"^.*?://[^/]*", "", u or "") if "://" in (u or "") else "") for u in urls]
    assert got == {i: {"7": 1, "8": 1, "9": 0}.get(m and m[1]) for i, m in enumerate(number)}


def test_gif_documents(docs, texts):
    out = gif_media.digests(gif_media.texts_as_gifs(docs)).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        n, payload = gif_media.payload_of(texts[8 if r["doc_id"] is None else r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    shown = gif_media.frames(gif_media.texts_as_gifs(docs).withColumnRenamed("doc_id", "id")).collect()
    assert all(len(f["rgba"]) == 4 * f["width"] * f["height"] for f in shown)


def plain_components(rows):
    sets, parent = {}, {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[d] = d

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


@pytest.mark.parametrize("region", [4_000_000, 200])
def test_jaccard_join(spark, docs, texts, region):
    out = jaccard_join.linked(docs, region_shingles=region, range_shingles=500).collect()
    want = plain_components(list(enumerate(texts)))
    assert len(out) == len(texts) + 2
    for r in out:
        assert (r["n_shingles"], r["component_id"]) == want[8 if r["doc_id"] is None else r["doc_id"]]


@pytest.mark.parametrize("region", [4_000_000, 3000])
def test_jaccard_join_chains_and_large_groups(spark, region):
    """Copies at every distance around the limit: chains, a large group, and pairs just inside and outside."""
    r = random.Random(3)
    rows, base = [], [f"w{r.randrange(10**6)}" for _ in range(100)]
    for _ in range(60):  # a chain in which each differs a little from the one before
        base = list(base)
        base[r.randrange(100)] = f"w{r.randrange(10**6)}"
        rows.append(" ".join(base))
    hub = [f"v{r.randrange(10**6)}" for _ in range(100)]
    for _ in range(80):
        own = list(hub)
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(100)] = f"v{r.randrange(10**6)}"
        rows.append(" ".join(own))
    rows += [" ".join(f"u{r.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    rows = list(enumerate(rows))
    out = jaccard_join.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), region_shingles=region)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out.collect()} == plain_components(rows)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(50)] + [(500, 501), (500, 501)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    with Scratch(spark) as kept:
        got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "u long, v long"), kept).collect()}
    assert {k: v for k, v in got.items() if k != v} == {k: root(k) for k in parent if root(k) != k}


def plain_repeats(rows):
    big = 1 << 63
    rows = [(big if d is None else d, (t or "").encode()) for d, t in rows]
    first = {}
    for d, b in rows:
        for j in range(len(b) - 49):
            w = b[j : j + 50]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(1 for x in bytes(gone).split(b"\0") if x), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=40).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6), min_size=1, max_size=4), st.integers(1, 12))
def test_transforms_merge(shards, depth):
    for strings in shards:
        suffixes = sorted(([*s[i:], -1], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert bwt_merge.transform(strings) == bytes(strings[k][i - 1] + 1 if i else 0 for _, k, i in suffixes)
    want, got = {}, {}
    for k, s in enumerate(x for strings in shards for x in strings):
        for i in range(len(s) - depth + 1):
            want.setdefault(s[i : i + depth], []).append((k, i))
    for k, i, interval in zip(*(x.tolist() for x in bwt_merge.repeats([(bwt_merge.transform(x), len(x)) for x in shards], depth)), strict=True):
        got.setdefault(interval, []).append((k, i))
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_repeated_bytes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((1 << 63 if r[0] is None else r[0], *r[1:]) for r in repeated_bytes.repeated_bytes(docs).collect())
    assert got == plain_repeats(rows)


@pytest.mark.parametrize("wide", [20_000, 2, 0])
def test_repeated_bytes_of_pieces(spark, wide):
    """Texts cut from one another at all places, so that repeats end everywhere and overlap."""
    r = random.Random(4)
    pool = ["".join(r.choice("ab cd\né") for _ in range(r.randint(30, 200))) for _ in range(12)]
    rows = [(i if i % 9 else 3, "".join(p[r.randrange(20) : len(p) - r.randrange(20)] for p in r.sample(pool, 3))) for i in range(60)]
    got = sorted(tuple(x) for x in repeated_bytes.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), wide=wide).collect())
    assert got == plain_repeats(rows)


def test_stages_keep_columns_and_clean_documents(spark, docs):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "suffix_array_dedup", "secret_scans", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
    one = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert {0, 1, 8, 13, 14}.issubset(one) and not {9, 10, 11, 12} & one
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert out[0] is None and out[9] == "" and len(out[14]) < len(docs.where("doc_id = 14").first()["text"])


def test_pipeline_packs_what_the_stages_leave(spark):
    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    assert set(out.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and np.all(out.length > 0)
