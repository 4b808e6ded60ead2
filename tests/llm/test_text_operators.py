"""Quality rules, secret scans, packing, SentencePiece and language identification against plain versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import same
from tallyforge.llm import language_id, packing, quality_rules, registry, secret_scans, sentencepiece_bpe
from tallyforge.llm.common import ranked, stored

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t#\u00a0é😀", max_size=80))
def test_statistics(text):
    assert quality_rules.statistics(text)[:5] == plain_statistics(text)


def test_quality_edges(docs, texts):
    out = quality_rules.quality_rules(docs.withColumnRenamed("source", "host")).collect()
    assert len(out) == len(texts) + 2
    by = {r["doc_id"]: r for r in out}
    for i, t in enumerate(texts):
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_statistics(t)
        n, *_, rep = plain_statistics(t)
        assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and r["kept"] == (not r["base_failed"] and not r["depleted"])


def test_frequent_lines_go_and_depleted_documents_with_them(spark):
    shared, own = "Shared  LINE 7 of this host here today", "its own line number {} with many words so that it stays whole here"
    rows = [(i, "h", f"{shared}\n" + own.format("x" * i)) for i in range(8)] + [(20, "h", "shared line 0 of this host here today\nten"), (21, "other", f"{shared}\nab cd ef")]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, host string, text string"), max_documents=5).collect()}
    assert out[0]["removed_lines"] is None and all(out[i]["removed_lines"] == [0] and out[i]["kept"] for i in range(1, 8))
    assert out[20]["depleted"] and not out[20]["kept"] and not out[21]["depleted"]


def test_copies_alone_remove_no_line(spark):
    text = "one line of ten words is here for all to see\nand then another"
    out = quality_rules.quality_rules(spark.createDataFrame([(i, "h", text) for i in range(30)], "doc_id long, host string, text string"), max_documents=5)
    assert out.where("kept").count() == 30


def test_cleaned_keeps_columns(docs, spark):
    out = quality_rules.cleaned(docs, max_documents=1)
    assert out.columns == docs.columns and out.count() > 0 and quality_rules.cleaned(docs.limit(0)).count() == 0


def plain_secrets(t):
    t = t or ""
    a = [(m.start(), 0, m.end()) for m in secret_scans.ASSIGN.finditer(t) if len(m[2]) >= 6]
    a += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    a += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{secret_scans.KINDS[k]}:{s}:{e}" for s, k, e in sorted(a))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "apikey", "api_key", " ", "=", ":", '"', "abcdef1", "0" * 25, "AKIA" + "Z" * 17, "AKIA", "é", "ſecret"]), max_size=12).map("".join))
def test_base_secrets(text):
    got = ",".join(f"{secret_scans.KINDS[k]}:{s}:{e}" for s, k, e in secret_scans.finds(text) if k < 3)
    assert got == plain_secrets(text)


def test_weak_parts_need_company(spark, docs, texts):
    secret = "aB3" + "xYz9" * 10
    rows = [(1, f"login: somebody\nkey {secret} at https://db.example.com/x"), (2, f"only {secret} here"), (3, "see https://a.example.com and user: bob1"), (4, f"login: somebody {'word ' * 100} {secret}")]
    out = {r["doc_id"]: r["spans"] for r in secret_scans.secret_scans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.split(":")[0] for s in out[1].split(",")] == ["part_id", "part_secret", "part_endpoint"]
    assert out[2] == out[3] == out[4] == ""
    got = secret_scans.secret_scans(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        t = texts[8 if r["doc_id"] is None else r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(plain_secrets(t).encode()).hexdigest()


LONG = "aB3+" * 21 + "aB=="


@pytest.mark.parametrize(
    "text, parts",
    [
        ("AKIAABCDEFGH aws_secret_access_key=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ["part_id", "part_secret"]),
        ("https://db.example.com SecretAccessKey=wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ["part_endpoint", "part_secret"]),
        (f"https://store.example.net AccountKey={LONG};", ["part_endpoint", "part_secret"]),
        (f"login: somebody key {LONG}", ["part_id", "part_secret"]),
        ("login: somebody key " + "aB3x" * 5000, ["part_id", "part_secret"]),
        (f"mongodb+srv://db.example.net key {'aB3x' * 10}", ["part_endpoint", "part_secret"]),
        (f"postgresql+psycopg2://db.example.net key {'aB3x' * 10}", ["part_endpoint", "part_secret"]),
        (f"rediss://db.example.net key {'aB3x' * 10}", ["part_endpoint", "part_secret"]),
    ],
)
def test_linked_secrets_in_usual_forms(spark, text, parts):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = secret_scans.secret_scans(docs).first()["found"]
    assert [f["kind"] for f in found] == parts
    secret = next(text[f["start"] : f["end"]] for f in found if f["kind"] == "part_secret")
    assert secret in (LONG, text[-len(secret) :]) and len(secret) >= 40
    assert secret not in secret_scans.redacted(docs).first()["text"]


def test_texts_of_equal_hashes_keep_their_own_masks(spark, monkeypatch):
    """Where all 64-bit hashes of texts are the same, the id still tells rows apart."""
    monkeypatch.setattr(secret_scans, "_hashes", lambda text: {"h1": F.lit(1).cast("long"), "h2": F.lit(2).cast("long")})
    rows = [(1, "x password=abcdef1"), (2, "password=abcdef1 longer"), (None, "secret=qwertz9"), (3, "none")]
    out = {r["doc_id"]: r["text"] for r in secret_scans.redacted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: "x [secret]", 2: "[secret] longer", None: "[secret]", 3: "none"}


def test_redacted(docs):
    out = {r["doc_id"]: r["text"] for r in secret_scans.redacted(docs).collect()}
    assert out[21] == '[secret]" [secret]' and out[0] is None and secret_scans.redacted(docs).columns == docs.columns


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))
    out = packing.pack(docs, capacity=256).toPandas()
    sums = out.groupby("sequence_id").length.sum()
    assert sums.max() <= 256 and len(sums) <= 1.05 * out.length.sum() / 256 + 1
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.values == np.r_[0, np.cumsum(g.length.values)[:-1]]).all()
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want = [(k, s, len(ids[s : s + 256]), zlib.crc32(np.array(ids[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
        own = out[out.doc_id == i].sort_values("piece")[["piece", "start", "length", "ids_crc32"]].drop_duplicates()
        assert [tuple(map(int, r)) for r in own.values] == want
    assert packing.pack(docs.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 50), max_size=20))
def test_plan_places_each_piece_once(counts):
    bins, seen = {}, Counter()
    for length, first, start, per, at in packing.plan(counts, 60):
        n = min([r[1] for r in packing.plan(counts, 60) if r[0] == length and r[1] > first] + [counts[length]]) - first
        for k in range(n):
            seen[length] += 1
            bins.setdefault(start + k // per, []).append((at + k % per * length, length))
    assert seen == counts
    for b in bins.values():
        b.sort()
        assert all(x[0] == sum(y[1] for y in b[:i]) for i, x in enumerate(b)) and sum(x[1] for x in b) <= 60


def test_ranked_is_gapless_with_one_hot_key(spark):
    df = stored(spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 0, id % 5) AS k"))
    for g in ranked(df, ["k"], ["id"], "n", rows_per_bucket=50).toPandas().groupby("k"):
        assert sorted(g[1].n) == list(range(len(g[1])))


TEXT = st.text(alphabet=st.one_of(st.sampled_from("ab the▁ \n\t.,"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_sentencepiece_is_the_library(text):
    import sentencepiece

    path = packing.vocabulary("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = library.encode(text)
    assert sentencepiece_bpe.encode([text], path) == [ids]
    assert sentencepiece_bpe.decode(",".join(map(str, ids)), path) == library.decode(ids)


def test_sentencepiece_documents(docs, texts):
    out = sentencepiece_bpe.digests(docs).collect()
    assert len(out) == len(texts) + 2
    assert {r["doc_id"]: r["n_tokens"] for r in out}[0] == 0
    back = {r["doc_id"]: r["text"] for r in sentencepiece_bpe.decode_documents(sentencepiece_bpe.encode_documents(docs)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identify(docs.select("doc_id", "text", "lang")).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = out[out.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98 and out.score.between(0, 1).all()


def test_language_sample_is_bounded_and_frequencies_are_whole(spark):
    rows = [(7, f"hot text {chr(97 + i)}{chr(97 + i)}", "en") for i in range(20)] * 2 + [(100 + i, f"autre {chr(97 + i)}", "fr") for i in range(10)] + [(7, "123", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, F.lit(True), 5)
    own = [c for c in (language_id.counts(t) for _, t, _ in rows) if c is not None]
    want = np.log((1 + len(own)) / (1 + (np.stack(own) > 0).sum(axis=0))) + 1
    assert len(own) == 50 and np.allclose(model["idf"], want, atol=1e-5) and model["langs"] == ["en", "fr"]
    assert {r["lang"]: r["count"] for r in language_id.sampled(docs, 5).groupBy("lang").count().collect()} == {"en": 5, "fr": 5}
    assert language_id.sampled(docs, 400).count() == 31


def test_dirty_languages_are_bounded(spark, monkeypatch):
    rows = [(i, f"the words of text number {chr(97 + i % 26)}", "en") for i in range(60)] + [(100 + i, f"les mots du texte {chr(97 + i % 26)}", "fr") for i in range(50)]
    rows += [(1000 + i, f"noise {i}", f"lang{i:05}") for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known, n = language_id.learned(docs, language_id.LANGUAGES)
    assert n == 500 and known.count() == 60 + 50 + 498 and known.agg(F.max("lang")).first()[0] == "lang00497"
    model = language_id.fit(docs, F.lit(True))
    assert model["langs"][:3] == ["en", "fr", "lang00000"] and len(model["langs"]) == 500 and len(model["of"]) <= 4 * 500
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    monkeypatch.setattr(language_id, "SAMPLE", 20)
    out = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs).collect()}
    assert set(out.values()) == {"en", "fr"} and len(out) == len(rows)
    assert all(out[i] == "en" for i in range(60)) and all(out[100 + i] == "fr" for i in range(50))


def test_language_edges(docs, texts):
    out = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(out) == len(texts) + 1
    for i in (0, 1, 2, 3):
        assert out[i]["lang_pred"] == "und" and out[i]["score"] == 0
    assert out[8]["lang_pred"] in ("en", "fr") and language_id.identify(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", registry.ORACLE_SQL)
def test_against_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck(registry.ORACLE_SQL[name], SF))
