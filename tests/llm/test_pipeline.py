"""The whole pipeline against a plain version of its stages."""

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np

import corpus_pipeline
from tallyforge.llm import packing, quality_rules, secret_scans
from test_plain_versions import plain_spans
from test_set_operators import plain_components
from test_text_operators import WORD, plain_statistics

SF = "/root/testdata/sf0.001"


def plain_quality(docs, frequent):
    key = lambda line: re.sub("[0-9]", "0", " ".join(WORD.findall(line)).lower())
    texts, first = defaultdict(set), {}
    for d, (t, host) in docs.items():
        for line in t.split("\n"):
            if WORD.search(line):
                texts[host, key(line)].add(t)
                first[host, key(line)] = min(d, first.get((host, key(line)), d))
    out = {}
    for d, (t, host) in docs.items():
        n, *_, repeated = plain_statistics(t)
        gone = lambda x: WORD.search(x) and len(texts[host, key(x)]) > frequent and first[host, key(x)] != d  # noqa: B023, E731
        cut = sum(len(WORD.findall(x)) for x in t.split("\n") if gone(x))
        if n >= 10 and 100 * repeated <= 20 * n and 100 * cut <= quality_rules.MAX_REMOVED_PERCENT * n:
            out[d] = "\n".join(x for x in t.split("\n") if not gone(x))
    return out


def plain_without_repeats(docs):
    first = {}
    for d, t in docs.items():
        b = t.encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(d, first.get(b[j : j + 50], d))
    out = {}
    for d, t in docs.items():
        b = t.encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < d:
                gone[j : j + 50] = b"\1" * 50
        out[d] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t
    return out


def masked(text):
    out, at = "", 0
    for s, e in [tuple(map(int, x.split(":")[1:])) for x in plain_spans(text, secret_scans.SCOPE).split(",") if x]:
        if s >= at:
            out += text[at:s] + secret_scans.MASK
        at = max(at, e)
    return out + text[at:]


@lru_cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))


def test_pipeline_is_the_plain_one(spark):
    docs = {r["doc_id"]: (r["text"] or "", r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    texts = plain_quality(docs, quality_rules.MAX_DOCUMENTS)
    groups = plain_components(list(texts.items()))
    texts = plain_without_repeats({d: t for d, t in texts.items() if groups[d][1] == d})
    want = Counter()
    for d, t in texts.items():
        ids = [*library().encode(masked(t), add_special_tokens=False).ids, 0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            piece = ids[s : s + 2048]
            want[d, k, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    places = defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
