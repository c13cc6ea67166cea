r"""Line dedup: lines that stand in many documents go, except in one of them. DataFrame functions only.

A text is split at ``\n``. A line's key is the line without ``[\x20\x09-\x0D]`` at both ends and with A-Z lower-cased.
Lines are exploded with their place, keys of at least ``LEAST_CHARS`` code points become a pair of 64-bit hashes, and
distinct documents are counted per pair: first one row per pair and document, then partial sums per pair, so that a line
that a third of all documents hold is no task's burden. Keys found in ``LEAST_DOCS`` documents lose all their lines but
those of the largest doc_id. The lines met with these keys (a join that Spark splits where a key is skewed) give places to
drop per text, and the text is put together again from the places that are left. Texts travel once, lines never.

Defined cases: null or empty text is one empty line; rows with one doc_id are one document, and rows without doc_id are
together one document that is smaller than all others; identical rows lose the same lines; a text all of whose lines go is
empty; empty tables give no rows; other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_id, stored

LEAST_CHARS, LEAST_DOCS = 40, 5
#: What is stripped from a line, and the letters that are lower-cased.
SPACE, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASHES = ("h1", "h2")


def _text() -> Column:
    return F.coalesce("row.text", F.lit(""))


def _lower(line: Column) -> Column:
    """A-Z lower-cased; lines of ASCII take the fast way to the same result."""
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _with_keys(docs: DataFrame) -> DataFrame:
    """row, did, fp: one row per row of docs; identical rows share (did, fp)."""
    return docs.select(F.struct("*").alias("row")).select("row", key_id("row.doc_id").alias("did"), F.xxhash64(_text()).alias("fp"))


def _long_lines(keyed: DataFrame, least_chars: int) -> DataFrame:
    """did, fp, place and key hashes of every line whose key is long enough."""
    lines = keyed.select("did", "fp", F.posexplode(F.split(_text(), "\n")).alias("place", "line"))
    keys = lines.select("did", "fp", "place", F.btrim("line", F.lit(SPACE)).alias("line")).where(F.char_length("line") >= least_chars)
    return keys.withColumn("line", _lower(F.col("line"))).select("did", "fp", "place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def frequent_lines(lines: DataFrame, least_docs: int) -> DataFrame:
    """Hashes of keys in at least least_docs documents, and the document that keeps its lines."""
    per_doc = lines.select(*_HASHES, "did").distinct()
    counted = per_doc.groupBy(*_HASHES).agg(F.count("*").alias("n"), F.max("did").alias("keeper"))
    return counted.where(F.col("n") >= least_docs).drop("n")


def _judged(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """row, lines, n_lines and n_dropped, and kept: the text that is left."""
    keyed = _with_keys(docs)
    lines = _long_lines(keyed.select(F.struct("row.text").alias("row"), "did", "fp"), least_chars)
    often = stored(frequent_lines(lines, least_docs))  # stored, so that both sides of the join are shuffled by it and can be split
    gone = lines.join(often, list(_HASHES)).where("did <> keeper").groupBy("did", "fp").agg(F.collect_set("place").alias("gone"))  # one text's places
    met = keyed.join(stored(gone), ["did", "fp"], "left")
    split = met.select("row", "gone", F.split(_text(), "\n").alias("lines"))
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), _text()).otherwise(F.array_join(F.transform(places, lambda i: F.get(F.col("lines"), i)), "\n"))
    return split.select("row", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def drop_repeated_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The documents with all their columns, their texts without the dropped lines (a null text stays null)."""
    judged = _judged(docs, least_chars, least_docs)
    text = F.when(F.col("row.text").isNotNull(), F.col("kept")).alias("text")
    return judged.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def line_digests(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc_id, n_lines before dropping, n_dropped, and the SHA-256 of what is left, per row of docs."""
    judged = _judged(docs.select("doc_id", "text"), least_chars, least_docs)
    return judged.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
