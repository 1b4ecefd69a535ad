"""Queries over events, documents, conversations, labels, pages and the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rnd import md5_key, uniform
from ..operators import choices, clean, instruct, metrics, retrieval, sampling, windows, within
from ..operators.ordered import small
from ..sources import store
from ..sources.store import missing_keys
from .registry import Tables, query

R = lambda c, n=6: F.round(c, n)
_U = "('0x' || substr(md5(concat_ws('|', '{0}', {1})), 1, 8))::BIGINT / 4294967296.0"


def hashed(seed: int, key: str) -> str:
    """SQL of uniform(seed, key)."""
    return _U.format(seed, key)


# Scans and partitions -------------------------------------------------------------------------------------------


@query("s2_select_partitions", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND source NOT IN ('src0', 'src3')")
def _(t):
    return t.documents.where((F.col("lang") == "en") & ~F.col("source").isin("src0", "src3")).select("doc_id", "lang", "source")


@query("s4_read_all_fields", "SELECT doc_id, md5(trim(text)) AS clean, n_chars::FLOAT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.trim("text")).alias("clean"), F.col("n_chars").cast("float").alias("n"))


@query("s7_append_log", "SELECT event_id, user_id, 1000 + row_number() OVER (ORDER BY ts, event_id) AS log_idx FROM events")
def _(t):
    """Goes on from a log whose last idx is 1000."""
    log = t.spark.range(1).select(F.lit(1000).cast("long").alias("idx"))
    return store.append_log(t.events, log, "ts", ["event_id"]).select("event_id", "user_id", F.col("idx").alias("log_idx"))


@query("s13_class_mapping", """SELECT p_partkey::VARCHAR AS key, lower(arg_min(v, n * 100 + i)) AS name FROM (SELECT p_partkey, i, trim(w) AS v, len(list_filter(regexp_split_to_array(trim(w), '\\s+'), lambda x: x <> '')) AS n
FROM (SELECT p_partkey, unnest(string_split(replace(p_name, 'e', ','), ',')) AS w, unnest(range(0, len(string_split(replace(p_name, 'e', ','), ',')))) AS i FROM part)) GROUP BY p_partkey""")
def _(t):
    """Lines "key v1, v2, ..." made of part names."""
    lines = t.part.select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit("e"), F.lit(","))).alias("value"))
    return store.class_mapping(lines)


@query("s14_templates", "SELECT md5(trim(line)) AS template, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1")
def _(t):
    lines = t.documents.select(F.explode(F.split("text", "\n", -1)).alias("value"))
    return store.templates(lines).groupBy(F.md5("template").alias("template")).agg(F.count("*").alias("n"))


@query("s20_embed_cache", "SELECT DISTINCT md5(text) AS k FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))")
def _(t):
    """Keys not yet in the cache (here: labelled texts), each once."""
    keys = t.documents.select("doc_id", F.md5("text").alias("k"))
    return missing_keys(keys, "k", keys.join(t.labels.select("doc_id"), "doc_id", "left_semi"))


@query("s21_part_windows", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events), p AS (SELECT *, t - floor(n * 0.6) AS u, floor(n * 0.8) - floor(n * 0.6) AS len FROM r), w AS (SELECT *, unnest(range(0, greatest(floor((len - 8) / 3) + 1, 0)::BIGINT)) AS w FROM p WHERE u >= 0 AND u < len AND len >= 8) SELECT event_id, w AS \"window\", (u - w * 3)::BIGINT AS i FROM w WHERE u >= w * 3 AND u < w * 3 + 8")
def _(t):
    """Windows of 8 rows every 3, from six to eight tenths of each user's events."""
    return windows.part_windows(t.events, "user_id", "event_id", 0.6, 0.8, 8, 3).select("event_id", F.col("window").cast("long").alias("window"), F.col("i").cast("long").alias("i"))


@query("s21_trial_part", "SELECT event_id, t, t // 8 AS window_no FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE t >= floor(n * 0.6) AND t < floor(n * 0.8)")
def _(t):
    e = t.events.withColumn("o", F.struct("ts", "event_id"))
    return windows.trial_part(e, "user_id", "o", 0.6, 0.8).select("event_id", F.col("t").cast("long").alias("t"), F.floor(F.col("t") / 8).alias("window_no"))


# Filters and checks ----------------------------------------------------------------------------------------------


@query("p3_quarantine", "SELECT event_type, count(*) FILTER (isfinite(value) AND abs(value) < 100)::BIGINT AS good, count(*) FILTER (NOT (isfinite(value) AND abs(value) < 100))::BIGINT AS bad FROM events GROUP BY event_type")
def _(t):
    ok = F.coalesce(~F.isnan("value") & (F.abs("value") < 100), F.lit(False))
    return t.events.groupBy("event_type").agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad"))


@query("p4_next_valid", "SELECT event_id, coalesce(min(CASE WHEN event_id % 5 <> 0 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), min(CASE WHEN event_id % 5 <> 0 THEN event_id END) OVER (PARTITION BY user_id)) AS source FROM events")
def _(t):
    return clean.next_valid_by(t.events, "user_id", "event_id", F.col("event_id") % 5 != 0).select("event_id", "source")


@query("p6_length_between", "SELECT doc_id FROM documents WHERE n_chars BETWEEN 450 AND 600")
def _(t):
    return t.documents.where(F.col("n_chars").between(450, 600)).select("doc_id")


@query("p7_subject_filter", "SELECT event_id FROM events WHERE user_id IN (1, 5, 9)")
def _(t):
    return t.events.where(F.col("user_id").isin(1, 5, 9)).select("event_id")


@query("p10_min_std", "SELECT event_type, round(stddev_pop(value), 6) AS std, stddev_pop(value) > 0.01 AS ok FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(R(F.stddev_pop("value")).alias("std"), (F.stddev_pop("value") > 0.01).alias("ok"))


@query("p11_drop_keyword", "SELECT page_id FROM pages WHERE NOT contains(url, '/en/')")
def _(t):
    return clean.drop_keyword(t.pages, "url", "/en/").select("page_id")


@query("a22_filter_report", "SELECT count(*) FILTER (contains(url, '/en/'))::BIGINT AS removed, count(*)::BIGINT AS total, round(100.0 * count(*) FILTER (NOT contains(url, '/en/')) / count(*), 6)::DOUBLE AS kept_percent FROM pages")
def _(t):
    return clean.filter_report(t.pages, ~F.col("url").contains("/en/")).select("removed", "total", R(F.col("kept_percent").cast("double")).alias("kept_percent"))


@query("p12_drop_pure_text", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def _(t):
    return t.documents.join(t.labels.where("quality is not null"), "doc_id").select("doc_id")


@query("p13_drop_leading", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE NOT (r = 1 AND role <> 'user')")
def _(t):
    return instruct.drop_leading(t.conversations, "conv_id", "turn", "role", "user").select("conv_id", "turn")


@query("p14_check_alternation", "SELECT conv_id, turn, role, expected FROM (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) % 2 = 0 THEN 'user' ELSE 'assistant' END AS expected FROM conversations) WHERE role <> expected")
def _(t):
    return instruct.alternation_violations(t.conversations, "conv_id", "turn", "role", ("user", "assistant")).select("conv_id", "turn", "role", "expected")


@query("p16_reject_by_amplitude", "SELECT event_id, (count(*) OVER (PARTITION BY user_id) < 60) OR value <= 80 AS kept FROM events")
def _(t):
    return clean.reject_by_amplitude(t.events, "user_id", "value", 80.0, 60).select("event_id", "kept")


@query("p19_capitalise", "SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def _(t):
    return t.part.select("p_partkey", X.capitalise("p_name").alias("name"))


@query("p23_interpolate", """WITH s AS (SELECT user_id AS rec_id, date_trunc('day', ts) AS t, event_type AS channel, avg(value) AS value FROM events GROUP BY ALL),
w(target, channel, w) AS (VALUES ('a', 'click', 0.75), ('a', 'view', 0.25), ('b', 'view', 1.0))
SELECT rec_id, t, target, round(sum(w * value), 6) AS value FROM s JOIN w USING (channel) GROUP BY ALL""")
def _(t):
    s = t.events.groupBy(F.col("user_id").alias("rec_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("t"), F.col("event_type").alias("channel")).agg(F.avg("value").alias("value"))
    w = t.spark.createDataFrame([("a", "click", 0.75), ("a", "view", 0.25), ("b", "view", 1.0)], "target string, channel string, w double")
    return clean.interpolate_channels(s, w).withColumn("value", R("value"))


@query("p25_auto_scale", "SELECT event_id, round(value * (CASE WHEN s < 8e-3 THEN 1e6 WHEN s < 1 THEN 1000 ELSE 1 END), 6) AS scaled, s >= 1000 AS out_of_range FROM events JOIN (SELECT event_type, stddev_pop(value) AS s FROM events GROUP BY 1) USING (event_type)")
def _(t):
    return clean.auto_scale(t.events, "event_type", "value").select("event_id", R("scaled").alias("scaled"), "out_of_range")


@query("p26_shift_label", "SELECT doc_id, toxic + 1 AS up, quality - 1 AS down FROM labels")
def _(t):
    return t.labels.select("doc_id", (F.col("toxic") + 1).alias("up"), (F.col("quality") - 1).alias("down"))


@query("p27_require_existing", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query("p28_mcq_subset", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_linenumber = (SELECT max(l_linenumber) FROM lineitem)")
def _(t):
    top = t.lineitem.agg(F.max("l_linenumber").alias("l_linenumber"))
    return t.lineitem.join(F.broadcast(top), "l_linenumber").select("l_orderkey", "l_partkey")


@query("p30_modality_check", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL AND d.doc_id % 3 = 0 THEN 'both' WHEN l.doc_id IS NOT NULL THEN 'signal' WHEN d.doc_id % 3 = 0 THEN 'image' ELSE 'none' END AS modality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    j = t.documents.select("doc_id").join(t.labels.select("doc_id", F.lit(True).alias("s")), "doc_id", "left")
    signal, image = F.col("s").isNotNull(), F.col("doc_id") % 3 == 0
    return j.select("doc_id", F.when(signal & image, "both").when(signal, "signal").when(image, "image").otherwise("none").alias("modality"))


# Joins -----------------------------------------------------------------------------------------------------------


@query("j1_join_caption", "SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    c = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")


@query("j3_image_index", "SELECT event_id, p_partkey FROM events JOIN part ON p_partkey = (event_id % (20 * 10 * 4)) // 4 + 1")
def _(t):
    key = F.floor((F.col("event_id") % (20 * 10 * 4)) / 4) + 1
    return t.events.withColumn("k", key).join(t.part, F.col("k") == F.col("p_partkey")).select("event_id", "p_partkey")


@query("j3_image_index_forms", "SELECT event_id, (event_id % (12 * 10 * 4)) // 4 AS chosen, (event_id % (20 * 4)) // 4 AS pictures, event_id % (20 * 80) % 20 AS test, event_id % (12 * 80) % 20 AS test_chosen FROM events")
def _(t):
    """Chosen classes, chosen pictures, and test samples of 20 classes."""
    of = lambda **how: retrieval.image_index(F.col("event_id"), 20, **how)
    return t.events.select("event_id", of(classes=12).alias("chosen"), of(pictures=True).alias("pictures"), of(train=False).alias("test"), of(train=False, classes=12).alias("test_chosen"))


@query("j4_zip_join", "SELECT doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS r FROM benchmark) USING (r)")
def _(t):
    r = lambda df, key: sampling.numbered(df.select(key), F.col(key), "r")
    return r(t.documents, "doc_id").join(r(t.benchmark, "item_id"), "r").select("doc_id", "item_id")


@query("j5_asof_forward", "SELECT e.event_id, min(s.ts) AS match FROM events e LEFT JOIN events s ON s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts >= e.ts GROUP BY e.event_id")
def _(t):
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought"))
    return windows.asof_forward(t.events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", "bought").select("event_id", "match")


@query("j5_range_join", "SELECT e.event_id, count(*)::BIGINT AS n, round(sum(s.value), 6) AS v FROM events e JOIN events s ON s.user_id = e.user_id AND s.ts >= e.ts - INTERVAL 2 HOUR AND s.ts < e.ts + INTERVAL 2 HOUR WHERE e.event_type = 'purchase' GROUP BY e.event_id")
def _(t):
    e = t.events.where("event_type = 'purchase'").select("event_id", "user_id", (F.col("ts") - F.expr("INTERVAL 2 HOUR")).alias("a"), (F.col("ts") + F.expr("INTERVAL 2 HOUR")).alias("b"))
    s = t.events.select("user_id", F.col("ts").alias("t"), "value")
    return windows.range_join(e, s, "user_id", "a", "b", "t", 14400).groupBy("event_id").agg(F.count("*").alias("n"), R(F.sum("value")).alias("v"))


@query("j6_annotation_join", "SELECT a.page_id, count(*)::BIGINT AS n FROM (SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') AS s FROM pages) a JOIN (SELECT regexp_replace(url, '\\.[^./]*$', '') AS s FROM pages) b USING (s) GROUP BY 1")
def _(t):
    s = F.regexp_replace("url", r"\.[^./]*$", "")
    counts = t.pages.groupBy(s.alias("s")).agg(F.count("*").alias("n"))
    return t.pages.select("page_id", s.alias("s")).join(counts, "s").select("page_id", "n")


@query("j10_cache_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("j11_default_lookup", "SELECT doc_id, coalesce(w, 1.0)::DOUBLE AS weight FROM documents LEFT JOIN (VALUES ('en', 0.5), ('de', 2.0)) v(lang, w) USING (lang)")
def _(t):
    w = t.spark.createDataFrame([("en", 0.5), ("de", 2.0)], "lang string, w double")
    return t.documents.join(F.broadcast(w), "lang", "left").select("doc_id", F.coalesce("w", F.lit(1.0)).alias("weight"))


@query("j14_result_grid", "SELECT r_name, linestatus, k::INT AS k FROM region, (SELECT DISTINCT l_linestatus AS linestatus FROM lineitem), (VALUES (1), (5)) v(k)")
def _(t):
    k = t.spark.createDataFrame([(1,), (5,)], "k int")
    return t.region.select("r_name").crossJoin(t.lineitem.select(F.col("l_linestatus").alias("linestatus")).distinct()).crossJoin(k)


# Aggregates ------------------------------------------------------------------------------------------------------


@query("a1_count_by_partition", "SELECT lang, source, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def _(t):
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("a2_inverse_frequency_weights", "SELECT lang, n, round(s::DOUBLE / (g * n), 6) AS weight FROM (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1), (SELECT count(*) AS s, count(DISTINCT lang) AS g FROM documents)")
def _(t):
    return metrics.group_weights(t.documents, "lang").select("lang", "n", R("weight").alias("weight"))


@query("a3_sample_weights", "WITH w AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT doc_id, lang, round((1.0 / n) / (SELECT count(*) FROM w), 9)::DOUBLE AS sample_weight FROM documents JOIN w USING (lang)")
def _(t):
    return sampling.sample_weights(t.documents, "lang", "doc_id").withColumn("sample_weight", R("sample_weight", 9))


@query("a7_signal_stats", "SELECT event_type, max(n)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= 2000 GROUP BY event_type")
def _(t):
    sizes = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    head = sampling.limit_per_group(t.events, ["event_type"], 2000, "event_id")
    return head.groupBy("event_type").agg(R(F.avg("value")).alias("mean"), R(F.stddev_pop("value")).alias("std")).join(sizes, "event_type")


@query("a10_metric_choice", "SELECT lang, round(CASE WHEN lang = 'en' THEN avg(a) ELSE sum(c)::DOUBLE / sum(n) END, 6) AS metric FROM (SELECT lang, source, count(*) AS n, sum((quality = 1)::INT) AS c, avg((quality = 1)::INT) AS a FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY lang")
def _(t):
    j = t.documents.join(t.labels, "doc_id")
    per = j.groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("c"))
    return per.groupBy("lang").agg(R(F.when(F.col("lang") == "en", F.avg(F.col("c") / F.col("n"))).otherwise(F.sum("c") / F.sum("n"))).alias("metric"))


@query("a14_auroc", "WITH r AS (SELECT toxic = 1 AS y, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS k FROM labels JOIN documents USING (doc_id)) SELECT round(((sum(k) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)))::DOUBLE, 6) AS auroc FROM r")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return metrics.auroc(j, F.col("toxic") == 1, F.col("n_chars")).select(R("auroc").alias("auroc"))


@query("a15_binary_report", "WITH c AS (SELECT count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (NOT y AND NOT p) AS tn FROM (SELECT toxic = 1 AS y, n_chars >= 1500 AS p FROM labels JOIN documents USING (doc_id))) SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS sensitivity, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    out = metrics.binary_report(j, F.col("toxic") == 1, F.col("n_chars") >= 1500)
    return out.select("tp", "fp", "fn", "tn", *(R(c).alias(c) for c in ("precision", "sensitivity", "specificity", "f1")))


@query("a17_pr_auc", "WITH p AS (SELECT n_chars, sum((toxic = 1)::INT) AS p, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM p WINDOW w AS (ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING)) SELECT round((sum(p * cp::DOUBLE / cn) / sum(p))::DOUBLE, 6) AS pr_auc FROM c")
def _(t):
    j = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return metrics.average_precision(j, F.col("toxic") == 1, F.col("n_chars")).select(R("pr_auc").alias("pr_auc"))


@query("a18_latency_profile", """WITH k AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r > 100)
SELECT max(n)::BIGINT AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, max(value) FILTER (i = n // 2) AS median, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99, round(sum(value), 4) AS total, round(1000 / avg(value), 6) AS throughput FROM k""")
def _(t):
    return metrics.latency_profile(t.events, "value", "event_id", 100).withColumn("avg", R("avg")).withColumn("total", R("total", 4)).withColumn("throughput", R("throughput"))


@query("a19_token_lengths", "SELECT conv_id, (w + CASE WHEN img THEN 128 ELSE 0 END)::BIGINT AS length, (CASE WHEN img THEN w + 128 ELSE -w END)::BIGINT AS signed FROM (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w, bool_or(contains(text, 'the')) AS img FROM conversations GROUP BY 1)")
def _(t):
    return instruct.token_lengths(t.conversations, "conv_id", "text", F.col("text").contains("the"))


@query("a19_length_totals", "WITH l AS (SELECT CASE WHEN img THEN w + 128 ELSE -w END AS s FROM (SELECT conv_id, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS w, bool_or(contains(text, 'idiot')) AS img FROM conversations GROUP BY 1)) SELECT count(*) FILTER (s > 0)::BIGINT AS rows_with_image, count(*) FILTER (s < 0)::BIGINT AS rows_without, coalesce(sum(s) FILTER (s > 0), 0)::BIGINT AS total_with_image, coalesce(-sum(s) FILTER (s < 0), 0)::BIGINT AS total_without FROM l")
def _(t):
    return instruct.length_totals(instruct.token_lengths(t.conversations, "conv_id", "text", F.col("text").contains("idiot")))


def languages(t: Tables) -> DataFrame:
    """Each source's languages as one line of retrieval text."""
    from ..operators import retrieval

    langs = t.documents.where("lang is not null").select("source", "lang").distinct()
    ranked = langs.withColumn("rank", F.row_number().over(Window.partitionBy("source").orderBy("lang"))).withColumn("type", F.lit("language"))
    return retrieval.label_text(ranked, ["source"], "type", "lang", 5)


@query("a20_labels_by_type", "SELECT source, 'If task is language: ' || string_agg(l, ' | ' ORDER BY l) AS labels FROM (SELECT DISTINCT source, lang AS l FROM documents) GROUP BY source")
def _(t):
    return languages(t).withColumnRenamed("context", "labels")


@query("a21_recording_qc", "SELECT user_id, CASE WHEN remain <= 1 THEN 0 ELSE remain END::BIGINT AS remain, CASE WHEN remain <= 1 THEN 0 ELSE total END::BIGINT AS total, round(CASE WHEN remain <= 1 THEN 100 ELSE 100.0 * (total - remain) / total END, 6)::DOUBLE AS drop_rate, duration::BIGINT AS duration FROM (SELECT user_id, count(*) FILTER (value <= 50) AS remain, count(*) AS total, floor(epoch(max(ts)))::BIGINT - floor(epoch(min(ts)))::BIGINT AS duration FROM events GROUP BY 1)")
def _(t):
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    g = t.events.groupBy("user_id").agg(F.count_if(F.col("value") <= 50).alias("r"), F.count("*").alias("n"), (sec(F.max("ts")) - sec(F.min("ts"))).alias("duration"))
    bad = F.col("r") <= 1
    return g.select("user_id", F.when(bad, 0).otherwise(F.col("r")).alias("remain"), F.when(bad, 0).otherwise(F.col("n")).alias("total"), R(F.when(bad, 100.0).otherwise((F.col("n") - F.col("r")) * 100.0 / F.col("n"))).alias("drop_rate"), "duration")


# Sampling and order ----------------------------------------------------------------------------------------------


@query("r6_limit_first", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50")
def _(t):
    return sampling.limit_per_group(t.documents.select("doc_id", "lang"), ["lang"], 50, "doc_id")


@query("r6_limit_random", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', doc_id)), doc_id) AS r FROM documents) WHERE r <= 50")
def _(t):
    return sampling.limit_per_group(t.documents.select("doc_id", "lang"), ["lang"], 50, "doc_id", 42)


@query("r9_split_random", f"SELECT event_id, CASE WHEN {hashed(42, 'event_id')} < 0.9 THEN 'train' ELSE 'test' END AS split FROM events")
def _(t):
    return t.events.select("event_id", sampling.split_random("event_id", 42).alias("split"))


@query("r10_split_by_subject", f"SELECT event_id, CASE WHEN user_id IN (3, 4) THEN 'cross' WHEN {hashed(42, 'event_id')} < 0.9 THEN 'train' ELSE 'val' END AS split FROM events")
def _(t):
    return t.events.select("event_id", sampling.split_by_subject("user_id", "event_id", [3, 4], 42).alias("split"))


@query("r11_split_modulo", "SELECT event_id, CASE WHEN event_id % 10 < 9 THEN 'train' ELSE 'val' END AS split FROM events")
def _(t):
    return t.events.select("event_id", sampling.split_modulo("event_id").alias("split"))


@query("r12_split_tail", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.999 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM documents")
def _(t):
    return sampling.split_tail(t.documents, "doc_id", 0.999).select("doc_id", "split")


@query("r13_sample_fraction", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '8', doc_id))) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents) WHERE r <= floor(0.2 * n)")
def _(t):
    return sampling.sample_fraction(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 0.2, 8)


@query("r15_first_per_name", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def _(t):
    return sampling.first_per(t.part.select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("r17_expand_repeats", "SELECT doc_id, rep::INT AS rep FROM labels, range(0, 4) r(rep)")
def _(t):
    return sampling.expand_repeats(t.labels.select("doc_id"), 4)


@query("r18_dense_relabel", "SELECT o_orderkey, n::INT AS new_label FROM orders JOIN (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1 AS n FROM orders GROUP BY 1) USING (o_custkey)")
def _(t):
    return sampling.dense_relabel(t.orders.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "new_label")


@query("o1_sort_names", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey)::INT AS place FROM part")
def _(t):
    return t.part.select("p_brand", "p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")).alias("place"))


@query("o2_head_n", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 3000")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber").orderBy("l_orderkey", "l_linenumber").limit(3000)


@query("o5_union_all", "SELECT o_orderkey, 'a' AS part FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 'b' FROM orders WHERE o_totalprice > 100000")
def _(t):
    part = lambda where, p: t.orders.where(where).select("o_orderkey", F.lit(p).alias("part"))
    return part("o_orderstatus = 'O'", "a").unionByName(part("o_totalprice > 100000", "b"))


@query("o6_set_difference", "SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def _(t):
    gone = t.supplier.where("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return t.nation.join(gone, "n_nationkey", "left_anti").select("n_name")


@query("o7_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("o8_membership", "SELECT doc_id, lang IN ('de', 'fr') AS some, contains(text, 'the') AS has FROM documents")
def _(t):
    return t.documents.select("doc_id", F.col("lang").isin("de", "fr").alias("some"), F.col("text").contains("the").alias("has"))


# Windows over time -----------------------------------------------------------------------------------------------


@query("w1_time_epochs", "SELECT user_id, w AS start, count(*)::BIGINT AS n, round(sum(value), 6) AS v FROM (SELECT user_id, value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY ALL")
def _(t):
    """Two-hour epochs every hour."""
    e = t.events.select("user_id", "value", F.col("ts").cast("timestamp").alias("ts"))
    out = e.groupBy("user_id", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), R(F.sum("value")).alias("v"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "v")


@query("w2_time_tumbling", "SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _(t):
    e = t.events.select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("w5_time_crop", "SELECT event_id FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS a FROM events) WHERE ts BETWEEN a + INTERVAL 6 HOUR AND a + INTERVAL 30 HOUR")
def _(t):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("a"))
    j = t.events.select("event_id", "user_id", "ts").join(first, "user_id")
    return j.where("ts between a + interval 6 hour and a + interval 30 hour").select("event_id")


def _ma_sql(k: int, group: str = "event_type") -> str:
    """Means of k values around each row of a group, its ends repeated."""
    front = (k - 1) // 2
    back = k - 1 - front
    trend = f"(s + greatest({front} - (i - 1), 0) * f + greatest({back} - (n - i), 0) * l) / {k}"
    return f"""SELECT event_id, {trend} AS trend, value - {trend} AS rest FROM (SELECT event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY {group}) AS n, first_value(value) OVER w AS f,
last_value(value) OVER (PARTITION BY {group} ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, sum(value) OVER (PARTITION BY {group} ORDER BY event_id ROWS BETWEEN {front} PRECEDING AND {back} FOLLOWING) AS s FROM events WINDOW w AS (PARTITION BY {group} ORDER BY event_id))"""


@query("w6_w7_moving_average", f"SELECT event_id, round(trend, 6) AS trend, round(rest, 6) AS rest FROM ({_ma_sql(5, 'user_id')})")
def _(t):
    out = within.moving_average(t.events, "user_id", "event_id", "value", 5)
    return out.select("event_id", R("trend").alias("trend"), R("rest").alias("rest"))


@query("w7_decompose_kernels", "SELECT event_id, round((a.trend + b.trend) / 2, 6) AS trend, round((a.rest + b.rest) / 2, 6) AS rest FROM (%s) a JOIN (%s) b USING (event_id)" % (_ma_sql(5), _ma_sql(12)))
def _(t):
    """Two kernels, one of even length; event types are hot groups."""
    out = within.decompose(t.events, "event_type", "event_id", "value", [5, 12])
    return out.select("event_id", R("trend").alias("trend"), R("rest").alias("rest"))


@query("w8_exp_smooth", "WITH b AS (SELECT event_type, list(value ORDER BY event_id) AS v, list(event_id ORDER BY event_id) AS e FROM events GROUP BY 1), i AS (SELECT event_type, v, e, unnest(range(1, len(v) + 1)) AS i FROM b) SELECT e[i] AS event_id, round(list_sum(list_transform(range(0, least(i, 60)::BIGINT), lambda j: 0.5 * pow(0.5, j) * v[i - j])), 6) AS smooth FROM i")
def _(t):
    """Along each event type; what is over 60 rows back weighs less than 1e-18."""
    return within.exp_smooth(t.events, "event_type", "event_id", "value", 0.5).select("event_id", R("smooth").alias("smooth"))


@query("w8_exp_smooth_last", "WITH b AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, round(list_sum(list_transform(range(0, len(v)), lambda j: 0.5 * pow(0.5, j) * v[len(v) - j])), 6) AS last FROM b")
def _(t):
    return within.exp_smooth(t.events, "user_id", "event_id", "value", 0.5).groupBy("user_id").agg(R(F.max_by("smooth", "event_id")).alias("last"))


@query("w10_length_order", "WITH r AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY md5(concat_ws('|', '5', doc_id)), doc_id) - 1) // 64 AS megabatch FROM documents) SELECT doc_id, megabatch, (row_number() OVER (PARTITION BY megabatch ORDER BY n_chars DESC, doc_id) - 1)::INT AS place FROM r")
def _(t):
    return instruct.length_order(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 64, 5).select("doc_id", "megabatch", "place")


_CHUNKS = """WITH RECURSIVE o AS (SELECT doc_id, n_chars, megabatch, row_number() OVER (PARTITION BY megabatch ORDER BY n_chars DESC, doc_id) - 1 AS place, count(*) OVER (PARTITION BY megabatch) AS size FROM (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY md5(concat_ws('|', '5', doc_id)), doc_id) - 1) // 64 AS megabatch FROM documents)),
g AS (SELECT DISTINCT megabatch, -1::BIGINT AS place, [0, 0, 0, 0]::BIGINT[] AS total, [0, 0, 0, 0]::BIGINT[] AS n, -1::BIGINT AS chunk FROM o WHERE size % 4 = 0
UNION ALL SELECT megabatch, place, list_transform(range(0, 4), lambda i: total[i + 1] + CASE WHEN i = k THEN n_chars ELSE 0 END), list_transform(range(0, 4), lambda i: n[i + 1] + CASE WHEN i = k THEN 1 ELSE 0 END), k
  FROM (SELECT o.megabatch, o.place, o.n_chars, g.total, g.n, list_sort(list_transform(list_filter(range(0, 4), lambda i: g.n[i + 1] < size // 4), lambda i: [g.total[i + 1], i]))[1][2] AS k FROM g JOIN o ON o.megabatch = g.megabatch AND o.place = g.place + 1))
SELECT doc_id, megabatch, (CASE WHEN size % 4 = 0 THEN chunk ELSE place % 4 END)::INT AS chunk FROM o LEFT JOIN g USING (megabatch, place)"""


@query("w10_even_chunks", _CHUNKS)
def _(t):
    order = instruct.length_order(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", 64, 5)
    return instruct.even_chunks(order, "doc_id", "n_chars", 4)


@query("w11_pad_batch", """WITH b AS (SELECT conv_id, turn, conv_id // 8 AS batch, least(len(string_split(text, ' ')), 40) AS raw, len(string_split(text, ' ')) AS n0 FROM conversations), c AS (SELECT conv_id, turn, batch, CASE WHEN max(n0) OVER (PARTITION BY batch) > 40 THEN least(n0, 39) ELSE n0 END AS n FROM b), m AS (SELECT batch, max(n) AS w FROM c GROUP BY 1)
SELECT conv_id * 1000 + turn AS k, w::INT AS width, n::INT AS real, (w - n)::INT AS padded FROM c JOIN m USING (batch)""")
def _(t):
    ids = F.transform(F.split("text", " ", -1), lambda x: F.length(x))
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.floor(F.col("conv_id") / 8).alias("batch"), ids.alias("ids"), ids.alias("labels"))
    p = instruct.pad_batch(c, "batch", "k", "ids", "labels", -1, 40)
    return p.select("k", F.size("ids").alias("width"), F.size(F.filter("mask", lambda m: m)).alias("real"), F.size(F.filter("labels", lambda x: x == -100)).alias("padded"))


# Text ------------------------------------------------------------------------------------------------------------


@query("x1_decode_and_clean", "SELECT doc_id, md5(trim(text)) AS t FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.decode_and_clean("text")).alias("t"))


@query("x2_fixed_width", "SELECT doc_id, md5(rpad(text, 192, ' ')) AS t FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.fixed_width("text")).alias("t"))


@query("x3_captions", "SELECT event_id, 'Emotion Recognition Task. This person is watching ' || event_type || ' video.' AS a, 'Sleep Stage Recognition Task. This person is in ' || event_type || '.' AS b FROM events")
def _(t):
    return t.events.select("event_id", X.emotion_caption("event_type").alias("a"), X.sleep_caption("event_type").alias("b"))


@query("x4_label_by_words", "SELECT doc_id, CASE WHEN contains(text, 'ing') THEN 2 WHEN contains(text, 'en') THEN 1 WHEN contains(text, 'la') THEN 0 END::INT AS label FROM documents")
def _(t):
    return t.documents.select("doc_id", X.label_by_words("text", [("ing", 2), ("en", 1), ("la", 0)]).alias("label"))


@query("x4_label_strict", "SELECT doc_id, CASE WHEN contains(text, 'ing') THEN 2 WHEN contains(text, 'en') THEN 1 END::INT AS label FROM documents WHERE contains(text, 'ing') OR contains(text, 'en')")
def _(t):
    """No caption without a label is left, so nothing is raised."""
    known = t.documents.where(F.col("text").contains("ing") | F.col("text").contains("en"))
    return known.select("doc_id", X.label_by_words("text", [("ing", 2), ("en", 1)], strict=True).alias("label"))


@query("x5_class_from_caption", "SELECT p_partkey, regexp_replace(regexp_replace(list_aggregate(list_slice(string_split(p_type, ' '), -2, -1), 'string_agg', ' '), '\\.$', ''), '^a ', '') AS c, string_split(p_type, ' ')[1] AS w FROM part")
def _(t):
    return t.part.select("p_partkey", X.class_from_caption("p_type").alias("c"), X.word_at("p_type", 0).alias("w"))


@query("x6_option_letters", "SELECT l_orderkey, l_linenumber, CASE WHEN k < 26 THEN chr((65 + k)::INT) ELSE chr((64 + k // 26)::INT) || chr((65 + k % 26)::INT) END AS letter FROM (SELECT *, l_partkey % 60 AS k FROM lineitem)")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.option_letter(F.col("l_partkey") % 60).alias("letter"))


@query("x8_parse_answer", f"SELECT doc_id, regexp_replace(coalesce(list_extract(regexp_extract_all(text, '({X.ANSWER})', 1), -1), ''), '{X.ANSWER_SEPARATORS}', '', 'g') AS answer FROM documents")
def _(t):
    return t.documents.select("doc_id", X.parse_answer("text").alias("answer"))


@query("x11_prediction_code", "SELECT conv_id, turn, coalesce(map {'the': 1, 'of': 2, 'que': 3}[CASE WHEN w LIKE '(%' THEN left(w, 3) ELSE w END], -1)::INT AS code FROM (SELECT *, string_split(text, ' ')[3] AS w FROM conversations)")
def _(t):
    return t.conversations.select("conv_id", "turn", X.prediction_code("text", 2, {"the": 1, "of": 2, "que": 3}).alias("code"))


@query("x12_placeholder", f"SELECT conv_id, turn, md5(replace(CASE WHEN {hashed(2, 'conv_id, turn')} < 0.5 THEN '<image>' || chr(10) || trim(replace(text, '<image>', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) ELSE trim(replace(text, '<image>', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || '<image>' END, chr(10) || chr(10), chr(10))) AS t FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", F.md5(X.strip_placeholder("text", uniform(2, "conv_id", "turn") < 0.5)).alias("t"))


@query("x13_append_context", "SELECT conv_id, turn, md5(CASE WHEN role = 'user' AND n = 1 AND conv_id % 2 = 0 THEN text || chr(10) || 'context ' || conv_id ELSE text END) AS t FROM (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS n FROM conversations)")
def _(t):
    context = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("context "), F.col("conv_id").cast("string")))
    return instruct.append_context(t.conversations, "conv_id", "turn", "role", "text", "user", context).select("conv_id", "turn", F.md5("text").alias("t"))


@query("x14_sample_context", f"SELECT conv_id, turn, {hashed(15, 'conv_id, turn')} < 0.015 AS chosen FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", (uniform(15, "conv_id", "turn") < 0.015).alias("chosen"))


_STYLES = {
    "single": ("sys", "###", "", "'sys' || '###' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || '###' END, '' ORDER BY i)"),
    "two": ("sys", " ", "</s>", "'sys' || ' ' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || CASE WHEN i % 2 = 0 THEN ' ' ELSE '</s>' END END, '' ORDER BY i)"),
    "chatml": ("sys", "<|im_end|>", "", "'sys' || '<|im_end|>' || chr(10) || string_agg(CASE WHEN text = '' THEN role || chr(10) ELSE role || chr(10) || text || '<|im_end|>' || chr(10) END, '' ORDER BY i)"),
    "mpt": ("sys", "|", "", "'sys' || '|' || string_agg(CASE WHEN text = '' THEN role ELSE role || text || '|' END, '' ORDER BY i)"),
    "gemma": ("", "<eot>", "", "string_agg(CASE WHEN text = '' THEN role ELSE role || text || '<eot>' END, '' ORDER BY i)"),
    "llama_2": ("sys", "<s>", "</s>", "string_agg(CASE WHEN text = '' THEN '' WHEN i % 2 = 0 THEN '<s>[INST] ' || CASE WHEN i = 0 THEN '<<SYS>>' || chr(10) || 'sys' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || text || ' [/INST]' ELSE ' ' || text || '</s>' END, '' ORDER BY i)"),
    "plain": ("sys", "\n", "</s>", "'sys' || string_agg(CASE WHEN text = '' THEN '' ELSE text || CASE WHEN i % 2 = 0 THEN chr(10) ELSE '</s>' END END, '' ORDER BY i)"),
}


def _prompt(style: str, system: str, sep: str, sep2: str, sql: str) -> None:
    @query(f"x15_prompt_{style}", f"SELECT conv_id, md5({sql}) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY conv_id")
    def _(t):
        turns = instruct.collect_turns(t.conversations, "conv_id", "turn", "role", "text")
        return turns.select("conv_id", F.md5(X.render_prompt("turns", style, F.lit(system), sep, sep2)).alias("prompt"))


for _name, _how in _STYLES.items():
    _prompt(_name, *_how)


@query("x17_speaker_form", "SELECT conv_id, md5(string_agg('### ' || role || ': ' || text || chr(10), '' ORDER BY turn)) AS t FROM conversations GROUP BY conv_id")
def _(t):
    turns = instruct.collect_turns(t.conversations, "conv_id", "turn", "role", "text")
    return turns.select("conv_id", F.md5(F.array_join(F.transform("turns", lambda x: F.concat(F.lit("### "), x["role"], F.lit(": "), x["text"], F.lit("\n"))), "")).alias("t"))


@query("x18_loss_mask", "SELECT conv_id, sum(n)::BIGINT AS total, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END)::BIGINT AS kept FROM (SELECT conv_id, role, len(string_split(text, ' ')) AS n FROM conversations) GROUP BY conv_id")
def _(t):
    turns = instruct.collect_turns(t.conversations, "conv_id", "turn", "role", "text")
    ids = F.transform("turns", lambda x: F.transform(F.split(x["text"], " ", -1), lambda w: F.length(w)))
    mask = turns.select("conv_id", instruct.loss_mask("turns", ids, "assistant").alias("m"))
    return mask.select("conv_id", F.size("m").cast("long").alias("total"), F.size(F.filter("m", lambda x: x != -100)).cast("long").alias("kept"))


@query("x19_splice_placeholder", "SELECT conv_id, turn, len(string_split(text, 'the'))::BIGINT - 1 AS marks, list_sum(list_transform(string_split(text, 'the'), lambda c: len(string_split(c, ' '))))::BIGINT AS tokens FROM conversations")
def _(t):
    parts = F.transform(F.split("text", "the", -1), lambda c: F.transform(F.split(c, " ", -1), lambda w: F.length(w)))
    s = t.conversations.select("conv_id", "turn", instruct.splice_placeholder(parts, -200).alias("ids"))
    marks = F.size(F.filter("ids", lambda x: x == -200))
    return s.select("conv_id", "turn", marks.cast("long").alias("marks"), (F.size("ids") - marks).cast("long").alias("tokens"))


@query("x20_retrieval_text", "SELECT source, 'Related:' || chr(10) || 'If task is language: ' || string_agg(l, ' | ' ORDER BY l) AS t FROM (SELECT DISTINCT source, lang AS l FROM documents) GROUP BY source")
def _(t):
    return languages(t).select("source", F.concat(F.lit("Related:\n"), "context").alias("t"))


@query("x21_replace_words", f"SELECT doc_id, md5(regexp_replace(text, '(?i)\\b(?:{X.PICTURE_WORDS})s?\\b', 'EEG', 'g')) AS t FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(X.replace_words("text")).alias("t"))


@query("x22_path_parts", "SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '\\.[^.]*$', '') AS stem, string_split(url, '_')[1] AS before FROM pages")
def _(t):
    return t.pages.select("page_id", X.basename("url").alias("base"), X.stem("url").alias("stem"), X.before_underscore("url").alias("before"))


@query("x23_md5_key", "SELECT doc_id, md5(source || '/' || doc_id) AS k FROM documents")
def _(t):
    return t.documents.select("doc_id", F.md5(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("k"))


@query("x25_daily_log_name", "SELECT strftime(ts, '%Y-%m-%d') || '-conv.json' AS name, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(X.daily_log_name("ts").alias("name")).agg(F.count("*").alias("n"))


@query("x26_json_state", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("x26_turns_state", "SELECT conv_id, md5(to_json({'system': 'sys', 'roles': ['user', 'assistant'], 'messages': list([role, text] ORDER BY turn)})::VARCHAR) AS state FROM conversations GROUP BY conv_id")
def _(t):
    turns = instruct.collect_turns(t.conversations, "conv_id", "turn", "role", "text")
    return turns.select("conv_id", F.md5(X.turns_state("turns", F.lit("sys"), ["user", "assistant"])).alias("state"))


# Batch twins of the streams --------------------------------------------------------------------------------------


@query("z6_interaction_counts", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT (ts, user_id))::BIGINT AS n FROM events GROUP BY ALL")
def _(t):
    e = t.events.select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", "user_id").distinct()
    return e.groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query("z7_liveness", "SELECT user_id, max(ts) AS last_seen, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS expired FROM events GROUP BY user_id")
def _(t):
    now = t.events.agg(F.max("ts").alias("now"))
    seen = t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    return seen.crossJoin(F.broadcast(now)).select("user_id", "last_seen", (F.col("last_seen") < F.col("now") - F.expr("INTERVAL 1 DAY")).alias("expired"))


@query("z8_qc_totals", f"SELECT CASE WHEN {hashed(42, 'event_id')} < 0.9 THEN 'train' ELSE 'test' END AS split, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(sampling.split_random("event_id", 42).alias("split")).agg(F.count("*").alias("n"))


def mcq(t: Tables, options: int = 4, seed: int = 31) -> DataFrame:
    """Questions from documents: the language as the answer among seeded others."""
    return choices.questions(t.documents, "doc_id", "lang", options, seed, ["Which language?"]).select("doc_id", "question", "correct", F.col("lang").alias("name"))


_MCQ = """p AS (SELECT doc_id, lang, class, row_number() OVER (PARTITION BY doc_id ORDER BY (class = lang)::INT DESC, md5(concat_ws('|', '31', doc_id, class))) AS r FROM documents, (SELECT DISTINCT lang AS class FROM documents)),
o AS (SELECT doc_id, lang, class, row_number() OVER (PARTITION BY doc_id ORDER BY md5(concat_ws('|', '32', doc_id, class))) - 1 AS i FROM p WHERE r <= 4),
q AS (SELECT doc_id, 'Which language?' || string_agg(' (' || chr((65 + i)::INT) || ')' || class, '' ORDER BY i) AS question, max(CASE WHEN class = lang THEN chr((65 + i)::INT) END) AS correct, max(lang) AS name FROM o GROUP BY doc_id)"""


@query("c3_build_mcq", f"WITH {_MCQ} SELECT * FROM q")
def _(t):
    return mcq(t)


@query("x9_x10_parse_options", f"WITH {_MCQ}, m AS (SELECT doc_id, count(*)::BIGINT AS n FROM o WHERE i < 4 GROUP BY 1) SELECT q.doc_id, n, name AS chosen, coalesce(65 + q.doc_id % 5 < 65 + n AND chr((65 + q.doc_id % 5)::INT) = correct, false) AS valid FROM q JOIN m USING (doc_id)")
def _(t):
    """Rendered questions read back: the correct letter leads to the name; another letter, or one that is no option, is not valid."""
    m = mcq(t).withColumn("map", X.parse_options("question"))
    return m.select("doc_id", F.size("map").cast("long").alias("n"), F.try_element_at("map", F.col("correct")).alias("chosen"), X.valid_answer(F.char(F.lit(65) + (F.col("doc_id") % 5)), "correct", "map").alias("valid"))


@query("c4_score_mcq", f"""WITH {_MCQ}, s AS (SELECT name, chr((65 + doc_id % 5)::INT) = correct AS ok FROM q)
SELECT count(*)::BIGINT AS total, round(avg(ok::INT), 6) AS accuracy, round((SELECT avg(a) FROM (SELECT avg(ok::INT) AS a FROM s GROUP BY name)), 6) AS macro_accuracy FROM s""")
def _(t):
    """Predictions " The answer is X." parsed, validated and scored; a letter that is no option is wrong."""
    said = F.concat(F.lit("the answer is "), F.char(F.lit(65) + (F.col("doc_id") % 5)))
    m = mcq(t).withColumn("map", X.parse_options("question")).withColumn("ok", X.valid_answer(X.parse_answer(said), "correct", "map"))
    per = m.groupBy("name").agg(F.count("*").alias("n"), F.sum(F.col("ok").cast("long")).alias("c"))
    return per.agg(F.sum("n").alias("total"), R(F.sum("c") / F.sum("n")).alias("accuracy"), R(F.avg(F.col("c") / F.col("n"))).alias("macro_accuracy"))


@query("j13_prediction_answer", f"WITH {_MCQ} SELECT q.doc_id, class AS chosen FROM q LEFT JOIN o ON o.doc_id = q.doc_id AND chr((65 + o.i)::INT) = chr((65 + q.doc_id % 5)::INT)")
def _(t):
    m = mcq(t).select("doc_id", X.parse_options("question").alias("map"), F.char(F.lit(65) + (F.col("doc_id") % 5)).alias("letter"))
    return m.select("doc_id", F.try_element_at("map", F.col("letter")).alias("chosen"))


@query("c8_prepare_instructions", """WITH f AS (SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE NOT (r = 1 AND role <> 'user')),
p AS (SELECT conv_id, md5('sys' || '###' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || '###' END, '' ORDER BY turn)) AS prompt, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS n FROM f GROUP BY conv_id),
r AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws('|', '6', conv_id)), conv_id) - 1) // 16 AS megabatch FROM p)
SELECT conv_id, prompt, n::BIGINT AS length, megabatch, (row_number() OVER (PARTITION BY megabatch ORDER BY n DESC, conv_id) - 1)::INT AS place FROM r""")
def _(t):
    c = instruct.drop_leading(t.conversations, "conv_id", "turn", "role", "user")
    turns = instruct.collect_turns(c, "conv_id", "turn", "role", "text")
    n = F.aggregate(F.transform("turns", lambda x: X.word_count(x["text"])), F.lit(0), lambda a, v: a + v).cast("long")
    p = turns.select("conv_id", F.md5(X.render_prompt("turns", "single", F.lit("sys"), "###")).alias("prompt"), n.alias("length"))
    return instruct.length_order(p, "conv_id", "length", 16, 6).select("conv_id", "prompt", "length", "megabatch", "place")
