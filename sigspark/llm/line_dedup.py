"""Lines that many documents share, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\f\r"


def lowered(text: Column) -> Column:
    """A-Z lowered and nothing else; lower() does just that where every character is ASCII, and is faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key, lines) per row: a hash of the text, and for each line 128 bits of its key; null for a short key."""
    text = F.coalesce("text", F.lit(""))
    keys = F.transform(F.split(lowered(text), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    hashed = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"))))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), hashed.alias("lines"))


def common_lines(hashed: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2) of keys found in at least min_docs distinct documents. The distinct (key, document) pairs are counted in
    two steps, so a line of a third of all documents is no single task. Rows without doc_id count as one document."""
    seen = hashed.select("doc_id", F.explode(F.array_distinct("lines")).alias("k")).where("k is not null")
    pairs = seen.select("k.h1", "k.h2", "doc_id").distinct()
    return pairs.groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and kept (the text without its common lines) per row of docs(doc_id, text).

    A null or empty text is one empty line, and stays unless min_chars is 0. All lines of a common key go, in every
    document, whichever stands first. Repeated rows are one document in the count and each gives a result; a text
    all of whose lines go is empty. A very long text is one row of its lines' hashes; its work grows with its lines. An empty
    table gives an empty result. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hashed = scratch.save(line_hashes(plain, min_chars), "hashed")
    common = scratch.save(common_lines(hashed, min_docs), "common")
    places = hashed.select("doc_id", "key", F.posexplode("lines").alias("pos", "k")).where("k is not null").select("doc_id", "key", "pos", "k.h1", "k.h2")
    hits = places.join(common.hint("merge"), ["h1", "h2"])
    at = hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.array_sort(F.collect_set("pos")).alias("_at"))
    # A flag for each line up to the last one dropped, so that a line is looked up by its place.
    gap = lambda p, i: p - F.coalesce(F.get("_at", i - 1), F.lit(-1)) - 1
    flags = F.flatten(F.transform("_at", lambda p, i: F.array_append(F.array_repeat(F.lit(False), gap(p, i)), F.lit(True))))
    drops = scratch.save(at.select("_id", "_key", flags.alias("_flags"), F.size("_at").cast("long").alias("_n")), "drops")
    scratch.drop("hashed", "common")
    text = F.coalesce("text", F.lit(""))
    told = plain.select("doc_id", text.alias("text")).join(drops.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get("_flags", i), F.lit(False))), "\n")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return told.select("doc_id", n_lines.cast("long").alias("n_lines"), F.coalesce("_n", F.lit(0).cast("long")).alias("n_dropped"), F.when(F.col("_n").isNull(), F.col("text")).otherwise(left).alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dedup() of documents at 10 documents and 1 code point, with the kept text's digest."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_ORACLE_KEY = "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_OP7 = f"""
WITH lines AS (
  SELECT doc_id, pos, line, {_ORACLE_KEY} AS key FROM (
    SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT l.*, c.key IS NOT NULL AS gone FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
