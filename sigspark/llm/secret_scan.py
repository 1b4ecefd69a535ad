"""Secrets in texts, and credentials whose parts stand apart, with DataFrame functions only.

Base spans come from three patterns. The linking method adds weak candidates: access identifiers (short access ids,
user names, e-mail addresses), unlabelled base64 runs, and endpoints (addresses with or without a scheme, the domain of
an e-mail, IPv4 addresses). A weak candidate alone proves nothing; it is reported only where complementary parts lie
within scope code points of it: an identifier and a secret for an endpoint; for an identifier or a secret the other of both
if that one is of base strength, or the other of both and an endpoint. Candidates of a document are joined by intervals:
cut to overlapping scope buckets, joined on document and bucket, then compared by the gap between them. Texts
without a weak candidate never leave their scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts: an access-like id of an upper-case word, a named user or client, or an e-mail address; a run of 32 or more
#: base64 signs; an endpoint. A run of signs is looked at from its first one only, so long runs cost no more than short ones.
WEAK_ID = (
    r"""\bA[KS]IA[A-Z0-9]{8,15}\b"""
    r"""|\b(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
    r"""|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9])[A-Za-z0-9.-]*[A-Za-z0-9]"""
)
WEAK_SECRET = r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9+/=])"
ENDPOINT = (
    r"""https?://[A-Za-z0-9.-]+\.[a-z]{2,}[^\s\"'<>]*"""
    r"""|(?<![A-Za-z0-9_.:-])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])(?::[0-9]{1,5})?"""
    r"""|(?<![A-Za-z0-9_.-])(?:[a-z0-9-]++\.){1,8}[a-z]{2,}+(?![A-Za-z0-9_-])(?::[0-9]{1,5})?"""
)
KINDS = ["assign", "access", "hex", "id", "key", "endpoint"]
SCOPE = 400
#: What a text must hold for a match of each pattern (null: nothing cheaper to look for than the pattern).
HINTS = ["[:=]", "AKIA", None, r"@[A-Za-z0-9-]|[KS]IA[A-Z0-9]|[:=]", None, r"\.[a-z0-9]"]
#: Matches of a text whose spans are made in one go.
BLOCK = 64


def _once(value: Column, use) -> Column:
    """use(value), with value computed once a row however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(matches: Column, pieces: Column, keep=None) -> Column:
    """(start, end) code points of matches (one or more): each begins after all pieces and matches before it. Matches are taken BLOCK at a time: a
    block's length gives where the next one starts, so the cost of growing lists stays with the blocks."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    told = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), (keep(m) if keep else F.lit(True)).alias("ok")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.when(x["ok"], F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(none)).alias("out"))

    def block(x: Column, at: Column) -> Column:
        return F.aggregate(x, F.struct(at.alias("at"), none.alias("out")), add, lambda acc: acc["out"])

    def ahead(acc: Column, x: Column) -> Column:
        total = F.aggregate(x, F.lit(0), lambda n, v: n + v["gap"] + v["len"])
        return F.struct((acc["at"] + total).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda blocks: F.aggregate(blocks, zero, ahead, lambda acc: acc["out"])
    cut = lambda z: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(z) - 1) / BLOCK).cast("int"), F.lit(0))), lambda k: F.slice(z, k * BLOCK + 1, F.lit(BLOCK)))
    return _once(told, lambda z: _once(cut(z), lambda blocks: F.flatten(F.zip_with(blocks, starts(blocks), block))))


def _long_value(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= 6


def _hinted(i: int) -> Column:
    """The text, or null where it can hold no match of pattern i."""
    return F.col("text") if HINTS[i] is None else F.when(F.col("text").rlike(HINTS[i]), F.col("text"))


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with key (a hash of the text) and base and weak: arrays of (kind, start, end), kind a
    number in KINDS."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.select("doc_id", text.alias("text"))
    patterns = (ASSIGN, ACCESS, HEX, WEAK_ID, WEAK_SECRET, ENDPOINT)
    out = out.select("doc_id", "text", *(F.regexp_extract_all(_hinted(i), F.lit(p), F.lit(0)).alias(f"m{i}") for i, p in enumerate(patterns)))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    made = [F.when(F.size(f"m{i}") > 0, spans(F.col(f"m{i}"), F.split("text", p, -1), _long_value if i == 0 else None)).otherwise(empty).alias(f"s{i}") for i, p in enumerate(patterns)]
    out = out.select("doc_id", F.xxhash64("text").alias("key"), *made)

    def typed(i: int) -> Column:
        return F.transform(f"s{i}", lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")))

    return out.select("doc_id", "key", F.array_sort(F.concat(*(typed(i) for i in range(3)))).alias("base"), F.concat(*(typed(i) for i in range(3, 6))).alias("weak"))


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(doc_id, key, more): the weak candidates with complementary parts within scope code points (the gap between both
    intervals), by the rule above. A weak candidate that lies in a base span is none."""
    parts = scanned.where("size(weak) > 0").select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("s")).distinct().select("doc_id", "key", "s.*")
    role = F.when(F.col("kind").isin(1, 3), 0).when(F.col("kind").isin(0, 2, 4), 1).otherwise(2)
    first, last = (F.floor(F.col(c) / scope) for c in ("start", "end"))
    parts = parts.withColumn("role", role)
    weak = parts.where("kind >= 3").select("doc_id", "key", "kind", "role", "start", "end", F.explode(F.sequence(first - 1, last + 1)).alias("bucket"))
    renamed = [F.col(c).alias(f"{c}2") for c in ("doc_id", "key", "kind", "role", "start", "end")]
    other = parts.select(*renamed, F.explode(F.sequence(first, last)).alias("bucket2"))
    on = F.col("doc_id").eqNullSafe(F.col("doc_id2")) & (F.col("key") == F.col("key2")) & (F.col("bucket") == F.col("bucket2"))
    near = weak.join(other.hint("merge"), on).where(F.greatest("start", "start2") - F.least("end", "end2") <= scope)
    inside = (F.col("kind2") < 3) & (F.col("start2") <= F.col("start")) & (F.col("end") <= F.col("end2"))
    seen = {f"r{r}": F.col("role2") == r for r in range(3)} | {"base": (F.col("kind2") < 3) & (F.col("role2") == 1 - F.col("role")), "inside": inside}
    sums = near.groupBy("doc_id", "key", "kind", "role", "start", "end").agg(*(F.bool_or(c).alias(n) for n, c in seen.items()))
    good = sums.where("not inside and r0 and r1 and (role = 2 or base or r2)")
    return good.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "kind", "end")).alias("more"))


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, base and all, arrays of (start, kind, end) by start, then kind.

    Null and empty texts have no spans. Repeated rows each give a result. Equal spans of two kinds stay two. A very long text is
    scanned whole; a bucket holds no more of its parts than scope code points have room for. An empty table gives an
    empty result. Other columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    scanned = scratch.save(scan(docs), "scan")
    more = scratch.save(linked(scanned, scope), "linked").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "more")
    out = scanned.join(more.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("all"))


def _digest(spans_: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """secret_scan() of documents: counts and digest of the base spans, and all spans."""
    out = secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("all").alias("spans"))
