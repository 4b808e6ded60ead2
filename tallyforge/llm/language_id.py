"""Language identification by nearest centroid.

A text becomes character n-grams of one to three characters, hashed into ``DIMENSIONS`` slots,
weighted by log frequency and inverse document frequency, and normalised. The training vectors
of each language are clustered on the sphere into a few centroids; a text takes the language of
the centroid with the largest cosine. One that lies further from its centroid than nearly all
training texts of that centroid do is marked as rejected; the nearest language stays.

The classifier is fitted on at most ``PER_LANGUAGE`` labelled texts a language, chosen by a hash
of id and text, equal rows counting once, and on at most ``SAMPLE`` texts of the ``LANGUAGES`` most frequent languages (ties: first
in order), each with an equal part of them; the document frequencies come from all their training texts. Whole texts are predicted. Defined results: null texts and texts without a letter are
``und`` with score 0; so are all where nothing was learned; ties go to the language first in
order; a text of any length is counted whole, in one task; rows with null lang teach nothing; an empty table gives an empty table; other columns
aren't read.
"""

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyforge.llm.common import over_batches

#: Bound of the labelled texts of a language that the classifier is fitted on.
PER_LANGUAGE = 400
#: Bounds of the languages that are learned, and of the labelled texts of all of them; both are of use only where the labels are dirty.
LANGUAGES = 500
SAMPLE = 10_000
BUCKETS = 64
BITS = 12
DIMENSIONS = 1 << BITS
CENTROIDS = 4
ROUNDS = 12
#: A text is rejected beyond this quantile of its centroid's training distances, times the slack.
QUANTILE, SLACK = 0.99, 1.5
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased letters of the basic plane as themselves, all else as a space; beyond it, code points fold into it."""
    table = np.full(1 << 16, 32, np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) & 0xFFFF if len(low) == 1 else i
    return table


def counts(text: str | None) -> np.ndarray | None:
    """How often each slot's n-grams occur; None without a letter."""
    if not text:
        return None
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if raw.max() < 1 << 16:
        codes = _letters()[raw]
    else:  # a letter beyond the basic plane counts as itself
        beyond = np.array([ord(c) & 0xFFFF | 0xE000 if c.isalpha() else 32 for c in text], np.uint64)
        codes = np.where(raw < 1 << 16, _letters()[np.minimum(raw, 0xFFFF)], beyond)
    if not (codes != 32).any():
        return None
    codes = np.concatenate([[np.uint64(32)], codes, [np.uint64(32)]])
    codes = codes[np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32)]]
    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(64 - BITS)
    one = codes * a
    two = (one[:-1] + codes[1:]) * b
    three = (two[:-1] + codes[2:]) * a
    total = np.zeros(DIMENSIONS, np.int64)
    for h in (one, two, three):
        total += np.bincount((h >> c).astype(np.int64), minlength=DIMENSIONS)
    return total.astype(np.float32)


def normalised(rows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(rows) * idf
    return weighted / np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int = CENTROIDS) -> np.ndarray:
    """Unit centroids of unit rows: far-apart seeds, then rounds of spherical means."""
    seeds = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centroids = x[seeds]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        centroids = np.stack([x[own == j].mean(axis=0) if (own == j).any() else centroids[j] for j in range(len(seeds))])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids


def sampled(known: DataFrame, per_language: int) -> DataFrame:
    """lang and text of at most ``per_language`` different rows of ``known`` (doc_id, text, lang) a language.

    The least keys of each bucket of a language first, then the least of those, so that no task reads more than a bound.
    """
    keyed = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("key"))
    chosen = keyed.select("lang", "key").distinct().withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    for parts in (["lang", "bucket"], ["lang"]):
        chosen = chosen.withColumn("n", F.row_number().over(Window.partitionBy(*parts).orderBy("key"))).where(F.col("n") <= per_language).drop("n")
    # per_language rows a language, SAMPLE in all
    return keyed.join(F.broadcast(chosen.drop("bucket")), ["lang", "key"], "left_semi").groupBy("lang", "key").agg(F.first("text").alias("text")).drop("key")


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """The number of ``texts`` (text) with a letter, and in how many of them each slot occurs."""

    def fn(c):
        found = np.zeros(DIMENSIONS + 1, np.int64)
        for text in c["text"]:
            n = counts(text)
            if n is not None:
                found[:DIMENSIONS] += n > 0
                found[DIMENSIONS] += 1
        at = np.flatnonzero(found)
        return {"slot": at.tolist(), "texts": found[at].tolist()}

    out = np.zeros(DIMENSIONS + 1, np.int64)
    for r in over_batches(texts.select("text"), {"slot": "int", "texts": "bigint"}, fn).groupBy("slot").agg(F.sum("texts").alias("texts")).collect():  # a row a slot
        out[r["slot"]] = r["texts"]
    return int(out[DIMENSIONS]), out[:DIMENSIONS]


def learned(known: DataFrame, languages: int) -> tuple[DataFrame, int]:
    """The rows of ``known`` (lang and more) of its ``languages`` most frequent languages, and how many languages these are."""
    most = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()
    return (known.where(F.col("lang").isin([r["lang"] for r in most])) if len(most) == languages else known), len(most)


def fit(docs: DataFrame, training: Column, per_language: int = PER_LANGUAGE) -> dict:
    """A classifier from the rows of ``docs`` (doc_id, text, lang) for which ``training`` holds."""
    known = docs.where(training & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known, languages = learned(known, LANGUAGES)
    sample = sampled(known, min(per_language, SAMPLE // max(1, languages)))

    def fn(c):
        for lang, text in zip(c["lang"], c["text"], strict=True):
            n = counts(text)
            if n is not None:
                at = np.flatnonzero(n)
                yield {"lang": [lang], "slots": [at.astype(np.int32).tobytes()], "counts": [n[at].tobytes()]}

    rows = over_batches(sample.select("lang", "text"), {"lang": "string", "slots": "binary", "counts": "binary"}, fn).collect()  # bounded by SAMPLE
    langs = sorted({r["lang"] for r in rows})
    number = {lang: j for j, lang in enumerate(langs)}
    if not rows:
        return {"langs": [], "of": [], "idf": None, "centroids": None, "radius": None}
    x, y = np.zeros((len(rows), DIMENSIONS), np.float32), np.array([number[r["lang"]] for r in rows])
    order = sorted(range(len(rows)), key=lambda i: (rows[i]["lang"], bytes(rows[i]["slots"]), bytes(rows[i]["counts"])))
    for k, i in enumerate(order):
        x[k, np.frombuffer(rows[i]["slots"], np.int32)] = np.frombuffer(rows[i]["counts"], np.float32)
    y = y[order]
    n, found = document_frequencies(known)
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    x = normalised(x, idf)
    centroids, of, radius = [], [], []
    for j in range(len(langs)):
        own = clustered(x[y == j])
        far = 1 - (x[y == j] @ own.T)
        nearest = far.argmin(axis=1)
        for k in range(len(own)):
            mine = far[nearest == k, k]
            radius.append(float(np.quantile(mine, QUANTILE)) * SLACK if len(mine) else 1.0)
        centroids.append(own)
        of += [j] * len(own)
    return {"langs": langs, "of": np.array(of), "idf": idf, "centroids": np.concatenate(centroids), "radius": np.array(radius)}


PREDICTED = {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double", "rejected": "boolean"}


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as doc_id, held_out, lang_pred, score, rejected; only the text is looked at."""

    def fn(c):
        for i in range(0, len(c["text"]), 256):
            own = [counts(t) for t in c["text"][i : i + 256]]
            n = len(own)
            langs, scores, rejected = [UNKNOWN] * n, [0.0] * n, [True] * n
            known = [k for k, x in enumerate(own) if x is not None]
            if known and model["langs"]:
                cosine = normalised(np.stack([own[k] for k in known]), model["idf"]) @ model["centroids"].T
                best = cosine.argmax(axis=1)
                for k, b, s in zip(known, best.tolist(), cosine[np.arange(len(known)), best].tolist(), strict=True):
                    langs[k], scores[k], rejected[k] = model["langs"][model["of"][b]], min(1.0, max(0.0, s)), 1 - s > model["radius"][b]
            yield {"doc_id": c["doc_id"][i : i + 256], "held_out": c["held_out"][i : i + 256], "lang_pred": langs, "score": scores, "rejected": rejected}

    return over_batches(docs.select("doc_id", "held_out", "text"), PREDICTED, fn)


def identify(docs: DataFrame, folds: int = 5, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fits on the documents outside fold 0 and predicts every document; the fold is crc32 of the id as text, modulo ``folds``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))
    docs = docs.select("doc_id", "lang", "text", held_out.alias("held_out"))
    return predict(docs, fit(docs, ~F.col("held_out") & F.col("doc_id").isNotNull(), per_language))
