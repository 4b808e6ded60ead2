"""Line dedup: lines that many documents hold stay in one of them only.

Normalised lines are exploded and hashed; documents are counted by hash; lines over the threshold
go from all documents but the one with the largest id; the rest is put together by position.

A hash's documents are counted in two steps, by (hash, document) and then by hash, so that a
line in a third of all documents is pre-aggregated on the map side twice. Lines find their verdict by a join that is
split: hashes with more than a ``HOT_SHARE``-th of the lines of all shared hashes, of which
there can't be more than ``HOT_SHARE``, are broadcast; the others are joined by shuffle, where none is large.
A document's text is shuffled only to meet its own dropped positions.

Hashes have 128 bits. Defined results: a null or empty text is one empty line; texts of any length are
taken whole; rows that share an id count as one document; rows with a null id
count together as one document, smaller than all others; repeated rows get a row each; an empty table gives
an empty table; other columns, whatever their names, aren't read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import Scratch, stored

#: Code points of the shortest line that counts, and documents from which it is dropped.
MIN_CHARS, MIN_DOCUMENTS = 20, 3
#: Hashes that may be broadcast: those with more than this part of the lines.
HOT_SHARE = 1000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(SPACE)), UPPER, LOWER)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text_hash, position, h1, h2) of the lines of ``docs`` (doc_id, text) that count."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(split_lines(F.col("text"))).alias("position", "line"))
    rows = rows.where(F.length("line") >= min_chars).withColumn("line", key(F.col("line"))).where(F.length("line") >= min_chars)
    return rows.select("doc_id", "text_hash", "position", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def shared_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """Of hashed lines (h1, h2, lines, documents, last): the hashes that at least ``min_documents`` documents hold, and the largest id of those."""
    one = F.struct(F.col("doc_id"))  # a null id inside is a value that counts
    out = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(one).alias("documents"), F.max("doc_id").alias("last"))
    return out.where(F.col("documents") >= min_documents)


def dropped_lines(lines: DataFrame, shared: DataFrame, hot_share: int = HOT_SHARE) -> DataFrame:
    """(doc_id, text_hash, position) of the hashed lines that go; both tables are stored."""
    total = shared.agg(F.sum("lines")).first()[0] or 0
    is_hot = F.col("lines") * hot_share > F.lit(total)
    verdict = shared.select("h1", "h2", "last", is_hot.alias("hot"))
    hot = F.broadcast(verdict.where("hot").select("h1", "h2", "last"))
    goes = F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last"))
    by_broadcast = lines.join(hot, ["h1", "h2"])
    rest = lines.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti")
    by_shuffle = rest.join(verdict.where("NOT hot").select("h1", "h2", "last").hint("merge"), ["h1", "h2"])
    return by_broadcast.unionByName(by_shuffle).where(goes).select("doc_id", "text_hash", "position")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, hot_share: int = HOT_SHARE) -> DataFrame:
    """``docs`` (doc_id, text) as doc_id, n_lines, n_dropped and the text that is left, null only where no line is left."""
    docs = docs.select("doc_id", "text")
    with Scratch(docs.sparkSession) as kept:
        lines = kept.stored(hashed_lines(docs, min_chars))  # so texts are exploded once
        shared = kept.stored(shared_lines(lines, min_documents))
        dropped = dropped_lines(lines, shared, hot_share)
        # equal rows have equal positions
        positions = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("dropped"))
        d, p = docs.withColumn("text_hash", F.xxhash64("text")).alias("d"), positions.alias("p")
        both = d.join(p, F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("d.text_hash") == F.col("p.text_hash")), "left")
        rows = both.select(F.col("d.doc_id").alias("doc_id"), split_lines(F.col("d.text")).alias("lines"), F.coalesce("p.dropped", F.array().cast("array<int>")).alias("dropped"))
        n = F.size("lines")
        left = F.array_except(F.sequence(F.lit(0), n - 1), F.col("dropped"))
        text = F.when(F.size("dropped") == 0, F.array_join("lines", "\n")).when(F.size(left) > 0, F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n"))
        return stored(rows.select("doc_id", n.cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), text.alias("text")))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the text that is left."""
    out = deduplicated(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
