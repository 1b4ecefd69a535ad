"""Queries over the embeddings table: vectors, prototypes, retrieval and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rnd import uniform
from ..operators import choices, clean, matrices, metrics, retrieval, sampling, windows
from ..operators.ordered import small
from .benchmarks import floyd, numbers_sql
from .registry import Tables, query
from .tables import hashed

R = lambda c, n=6: F.round(c, n)


def _long(df: DataFrame, name: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(name).alias("pos", "v")).select(*keys, "pos", (R(F.col("v")) + 0.0).alias("v"))


_PROTO = """
p AS (SELECT label, pos, avg(v) AS m FROM (SELECT label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL),
pn AS (SELECT label, list(m ORDER BY pos) AS raw FROM p GROUP BY label),
proto AS (SELECT label AS class, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS vec FROM pn),
sims AS (SELECT vec_id, label, class, list_dot_product(embedding::DOUBLE[], vec) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS sim FROM embeddings, proto),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM sims)"""


def prototypes(t: Tables) -> DataFrame:
    return retrieval.class_prototypes(t.embeddings).withColumnRenamed("label", "class")


def scored(t: Tables) -> DataFrame:
    return retrieval.similarity_join(t.embeddings.select("vec_id", "label", "embedding"), prototypes(t), "embedding", "vec")


def ranked(t: Tables, k: int) -> DataFrame:
    return retrieval.nearest(t.embeddings.select("vec_id", "label", "embedding"), prototypes(t), "embedding", "vec", k, ["vec_id"], ["class"])


def hits(t: Tables) -> DataFrame:
    """Place of each vector's own class among all prototypes."""
    return retrieval.own_rank(t.embeddings, prototypes(t), "embedding", "vec", "vec_id", "label", "class")


@query("a4_class_prototypes", f"WITH {_PROTO} SELECT class, unnest(range(0, 64))::INT AS pos, round(unnest(vec), 6) AS v FROM proto")
def _(t):
    return _long(prototypes(t), "vec", "class")


@query("j9_similarity_join", f"WITH {_PROTO} SELECT vec_id, class, round(sim, 6) AS sim FROM sims")
def _(t):
    return scored(t).select("vec_id", "class", R("sim").alias("sim"))


@query("r1_topk", f"WITH {_PROTO} SELECT vec_id, class, rank::INT AS rank, round(sim, 6) AS sim FROM ranked WHERE rank <= 5")
def _(t):
    return ranked(t, 5).select("vec_id", "class", "rank", R("sim").alias("sim"))


@query("r1_topk_by_type", """WITH g AS (SELECT vec_id AS gid, label, label % 4 AS type, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id, gid, list_cosine_similarity(q.embedding::DOUBLE[], e) AS sim FROM embeddings q, g WHERE type = 2)
SELECT vec_id, gid, rank::INT AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, gid) AS rank FROM s) WHERE rank <= 3""")
def _(t):
    g = t.embeddings.select(F.col("vec_id").alias("gid"), (F.col("label") % 4).alias("type"), F.col("embedding").alias("g"))
    out = retrieval.topk_by_type(t.embeddings.select("vec_id", "embedding"), g, 2, 3, "embedding", "g", ["vec_id"], "type", ["gid"])
    return out.select("vec_id", "gid", "rank", R("sim").alias("sim"))


@query("r2_topk_by_candidates", f"WITH {_PROTO} SELECT vec_id, class, rank2::INT AS rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank2 FROM sims WHERE class IN (1, 3, 7)) WHERE rank2 <= 2")
def _(t):
    wanted = prototypes(t).where(F.col("class").isin(1, 3, 7, 99)).select("class")
    out = retrieval.topk_by_candidates(t.embeddings.select("vec_id", "embedding"), prototypes(t), wanted, 2, "embedding", "vec", ["vec_id"], "class", ["class"])
    return out.select("vec_id", "class", "rank", R("sim").alias("sim"))


_QUOTA = f"""WITH {_PROTO}, ty AS (SELECT *, class % 3 AS type FROM sims),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, type ORDER BY sim DESC, class) AS k FROM ty)"""


@query("r3_topk_with_type_quota", f"{_QUOTA} SELECT vec_id, class, type::INT AS type, (CASE WHEN k = 1 THEN 0 ELSE 1 END)::INT AS part, round(sim, 6) AS sim FROM r WHERE k = 1 OR (type = 0 AND k <= greatest(5, 3) - 3 + 1)")
def _(t):
    g = prototypes(t).withColumn("type", F.col("class") % 3)
    out = retrieval.topk_with_type_quota(t.embeddings.select("vec_id", "embedding"), g, 5, 0, "embedding", "vec", ["vec_id"], "type", ["class"])
    return out.select("vec_id", "class", "type", "part", R("sim").alias("sim"))


@query("r4_topn_hit", f"WITH {_PROTO} SELECT vec_id, rank <= 1 AS top1, rank <= 5 AS top5 FROM ranked WHERE class = label")
def _(t):
    return hits(t).select("vec_id", (F.col("rank") <= 1).alias("top1"), (F.col("rank") <= 5).alias("top5"))


@query("r5_recommend_topk", "SELECT label, least(floor(count(*) * 0.25), 420)::BIGINT AS k FROM embeddings GROUP BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).select("label", retrieval.recommended_k(F.col("n")).alias("k"))


@query("r5_jittered_topk", f"SELECT label, floor(least(floor(count(*) * 0.25), 420) * (0.9 + 0.2 * {hashed(8, 'label')}))::BIGINT AS k FROM embeddings GROUP BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).select("label", retrieval.recommended_k(F.col("n"), jitter=uniform(8, "label")).alias("k"))


@query("j9_logits", f"WITH {_PROTO} SELECT vec_id, class, round(sim * least(exp(2.5), 100), 6) AS warm, round(sim * least(exp(7), 100), 6) AS hot FROM sims")
def _(t):
    return scored(t).select("vec_id", "class", R(retrieval.logits(F.col("sim"), 2.5)).alias("warm"), R(retrieval.logits(F.col("sim"), 7)).alias("hot"))


@query("a8_accuracy", f"WITH {_PROTO} SELECT count(*)::BIGINT AS total, count(*) FILTER (class = label)::BIGINT AS correct, round(avg((class = label)::INT), 6) AS accuracy FROM ranked WHERE rank = 1")
def _(t):
    return metrics.accuracy(ranked(t, 1), F.col("class") == F.col("label")).select("total", "correct", R("accuracy").alias("accuracy"))


@query("a9_macro_accuracy", f"WITH {_PROTO} SELECT count(*)::BIGINT AS n_classes, round(avg(a), 6) AS macro_accuracy FROM (SELECT label, avg((class = label)::INT) AS a FROM ranked WHERE rank = 1 GROUP BY label)")
def _(t):
    return metrics.macro_accuracy(ranked(t, 1), "label", F.col("class") == F.col("label")).select("n_classes", R("macro_accuracy").alias("macro_accuracy"))


@query("a11_class_weighted_accuracy", f"WITH {_PROTO}, h AS (SELECT label, class = label AS ok FROM ranked WHERE rank = 1), c AS (SELECT label, count(*) AS n FROM h GROUP BY label), g AS (SELECT count(*) AS g, sum(n) AS t FROM c) SELECT round(sum(CASE WHEN ok THEN t::DOUBLE / (g * n) ELSE 0 END) / count(*), 6) AS weighted_accuracy, count(*)::BIGINT AS total FROM h JOIN c USING (label), g")
def _(t):
    return metrics.class_weighted_accuracy(ranked(t, 1), "label", F.col("class") == F.col("label")).select(R("weighted_accuracy").alias("weighted_accuracy"), "total")


@query("a12_balanced_topk_accuracy", f"WITH {_PROTO} SELECT round(avg(a), 6) AS top1, round(avg(b), 6) AS top5 FROM (SELECT label, avg((rank <= 1)::INT) AS a, avg((rank <= 5)::INT) AS b FROM ranked WHERE class = label GROUP BY label)")
def _(t):
    return metrics.topk_balanced(hits(t), "label", (1, 5)).select(R("top1").alias("top1"), R("top5").alias("top5"))


def _kway_sql(k: int) -> str:
    return f"""SELECT {k} AS k, count(*)::BIGINT AS n, round(avg((r = 1)::INT), 6) AS accuracy FROM (SELECT label, class, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS r FROM sims
JOIN (SELECT vec_id, unnest(list_append({floyd('m - 1', str(k - 1), 42, f'vec_id, {k}', 'c')}, c)) AS c FROM embeddings JOIN num ON class = label, (SELECT count(*) AS m FROM num)) USING (vec_id) JOIN num USING (class, c)) WHERE class = label"""


def _kway_all() -> str:
    return f"WITH {_PROTO}, num AS {numbers_sql('embeddings', 'label')} " + " UNION ALL ".join(_kway_sql(k) for k in (2, 4, 10))


def _distractors_sql() -> str:
    return f"WITH num AS {numbers_sql('embeddings', 'label')} SELECT vec_id, label, class FROM (SELECT vec_id, label, unnest({floyd('m - 1', '3', 7, 'vec_id', 'c')}) AS c FROM embeddings JOIN num ON class = label, (SELECT count(*) AS m FROM num)) JOIN num USING (c)"


@query("a13_kway_accuracy", _kway_all())
def _(t):
    h = choices.kway_hits(t.embeddings, prototypes(t), [2, 4, 10], "vec_id", "label", "embedding", 42)
    return h.groupBy("k").agg(F.count("*").alias("n"), R(F.avg((F.col("rank") == 1).cast("double"))).alias("accuracy"))


@query("j8_distractors", _distractors_sql())
def _(t):
    return choices.negatives(t.embeddings, t.embeddings.select(F.col("label").alias("class")), "vec_id", "label", 4, 7)


@query("j2_join_prototype", f"WITH {_PROTO} SELECT vec_id, label, round(list_dot_product(embedding::DOUBLE[], vec), 6) AS d FROM embeddings JOIN proto ON class = label")
def _(t):
    p = small(prototypes(t).withColumnRenamed("class", "label"))
    return t.embeddings.join(p, "label").select("vec_id", "label", R(vec.dot("embedding", "vec")).alias("d"))


@query("j15_prototypes_by_dataset", """WITH e AS (SELECT *, vec_id % 3 AS dataset FROM embeddings),
p AS (SELECT dataset, label, pos, avg(v) AS m FROM (SELECT dataset, label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM e) GROUP BY ALL),
g AS (SELECT dataset, label AS class, list(m ORDER BY pos) AS vec FROM p GROUP BY ALL),
s AS (SELECT e.dataset, vec_id, label, class, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], vec) DESC, class) AS r FROM e JOIN g ON e.dataset = g.dataset)
SELECT dataset, count(*)::BIGINT AS n, round(avg((class = label)::INT), 6) AS accuracy FROM s WHERE r = 1 GROUP BY dataset""")
def _(t):
    e = t.embeddings.withColumn("dataset", F.col("vec_id") % 3)
    g = retrieval.class_prototypes(e, by=["dataset"]).withColumnRenamed("label", "class")
    best = retrieval.topk(retrieval.similarity_join(e, g, "embedding", "vec", on=["dataset"]), ["vec_id"], 1, ["class"])
    return best.groupBy("dataset").agg(F.count("*").alias("n"), R(F.avg((F.col("class") == F.col("label")).cast("double"))).alias("accuracy"))


@query("a6_trial_average", "SELECT g, pos::INT AS pos, round(avg(v), 6) AS v FROM (SELECT vec_id // 4 AS g, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY ALL")
def _(t):
    return _long(matrices.means(t.embeddings.withColumn("g", F.floor(F.col("vec_id") / 4)), ["g"], "embedding"), "vec", "g")


@query("a16_confusion", f"WITH {_PROTO} SELECT label, class, count(*)::BIGINT AS n FROM ranked WHERE rank = 1 GROUP BY ALL")
def _(t):
    return metrics.confusion(ranked(t, 1), "label", "class")


_CLASS = """c AS (SELECT label, class, count(*) AS n FROM ranked WHERE rank = 1 GROUP BY ALL),
s AS (SELECT label AS k, sum(n) AS support, sum(CASE WHEN label = class THEN n ELSE 0 END) AS tp FROM c GROUP BY 1),
gv AS (SELECT class AS k, sum(n) AS given FROM c GROUP BY 1), b AS (SELECT s.k, support, tp, coalesce(given, 0) AS given FROM s LEFT JOIN gv USING (k)),
o AS (SELECT avg(2.0 * tp / (support + given)) AS f1_macro, sum(2.0 * tp / (support + given) * support) / sum(support) AS f1_weighted, avg(tp / support) AS recall_macro, sum(tp) / sum(support) AS accuracy, sum(support * given) / sum(support) / sum(support) AS pe FROM b)"""


@query("a15_a17_class_report", f"WITH {_PROTO}, {_CLASS} SELECT round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted, round(recall_macro, 6) AS recall_macro, round(accuracy, 6) AS accuracy, round((accuracy - pe) / (1 - pe), 6) AS kappa FROM o")
def _(t):
    return metrics.class_report(ranked(t, 1), "label", "class").select(*(R(c).alias(c) for c in ("f1_macro", "f1_weighted", "recall_macro", "accuracy", "kappa")))


@query("a14_auroc_multiclass", f"""WITH {_PROTO}, r AS (SELECT class, label = class AS y, rank() OVER (PARTITION BY class ORDER BY round(sim, 9)) + (count(*) OVER (PARTITION BY class, round(sim, 9)) - 1) / 2.0 AS k FROM sims),
a AS (SELECT class, (sum(CASE WHEN y THEN k ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auc FROM r GROUP BY class)
SELECT round(avg(auc), 6)::DOUBLE AS auroc FROM a""")
def _(t):
    per = metrics.auroc_by(scored(t), ["class"], F.col("class") == F.col("label"), F.round("sim", 9))
    return per.agg(R(F.avg("auroc")).alias("auroc"))


@query("a25_retrieval_sanity", f"WITH {_PROTO} SELECT round(avg((class = label)::INT), 6) AS accuracy, avg((class = label)::INT) >= 0.4 AS ok FROM ranked WHERE rank = 1")
def _(t):
    a = F.avg((F.col("class") == F.col("label")).cast("double"))
    return ranked(t, 1).agg(R(a).alias("accuracy"), (a >= 0.4).alias("ok"))


@query("a26_mean_abs_cosine", "SELECT count(*)::BIGINT AS n, round(avg(abs(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS mean_abs_cosine, avg(abs(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))) > 0.044 AS ok FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    m = F.avg(F.abs(vec.cosine("embedding", "other")))
    return t.embeddings.join(b, "vec_id").agg(F.count("*").alias("n"), R(m).alias("mean_abs_cosine"), (m > 0.044).alias("ok"))


@query("a27_contrastive_loss", """WITH e AS (SELECT vec_id // 32 AS batch, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
l AS (SELECT a.batch, a.vec_id AS q, b.vec_id AS k, least(exp(2.0), 100) * list_cosine_similarity(a.v, b.v) AS x FROM e a JOIN e b USING (batch)),
r AS (SELECT batch, q, ln(sum(exp(x))) - max(CASE WHEN q = k THEN x END) AS c FROM l GROUP BY ALL), s AS (SELECT batch, k, ln(sum(exp(x))) - max(CASE WHEN q = k THEN x END) AS c FROM l GROUP BY ALL)
SELECT r2.batch, round((a + b) / 2, 6) AS loss FROM (SELECT batch, avg(c) AS a FROM r GROUP BY 1) r2 JOIN (SELECT batch, avg(c) AS b FROM s GROUP BY 1) s2 USING (batch)""")
def _(t):
    e = t.embeddings.select(F.floor(F.col("vec_id") / 32).alias("batch"), "vec_id", vec.l2_normalize("embedding").alias("v"))
    out = matrices.contrastive_loss(e, "batch", "vec_id", "v", "v", F.least(F.exp(F.lit(2.0)), F.lit(100.0)))
    return out.select("batch", R("loss").alias("loss"))


@query("a28_cross_entropy", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM e)
SELECT round(avg(0.8 * (z - v[label + 1]) + 0.2 * (z - list_avg(v))), 6) AS ce, round(avg(list_sum(list_transform(v, lambda x: (x - 0.5) * (x - 0.5))) / 64), 6) AS mse FROM l""")
def _(t):
    ce = metrics.smoothed_cross_entropy(F.col("embedding"), F.col("label"), 0.2)
    mse = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, v: a + (v - 0.5) * (v - 0.5)) / 64
    return t.embeddings.agg(R(F.avg(ce)).alias("ce"), R(F.avg(mse)).alias("mse"))


@query("a29_loss_mix", """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), l AS (SELECT *, ln(list_sum(list_transform(v, lambda x: exp(x)))) AS z FROM e)
SELECT label, round(0.7 * avg(z - v[label + 1]) + 0.3 * avg(list_sum(list_transform(v, lambda x: x * x))), 6) AS loss FROM l GROUP BY label""")
def _(t):
    ce = metrics.smoothed_cross_entropy(F.col("embedding"), F.col("label"), 0.0)
    return t.embeddings.groupBy("label").agg(R(0.7 * F.avg(ce) + 0.3 * F.avg(F.pow(vec.norm("embedding"), F.lit(2.0)))).alias("loss"))


_CODE = f"""WITH {_PROTO}, a AS (SELECT vec_id, class AS code FROM ranked WHERE rank = 1)"""


@query("n13_nearest_code", f"{_CODE} SELECT vec_id, code FROM a")
def _(t):
    """On unit vectors the smallest squared distance is the largest cosine."""
    return ranked(t, 1).select("vec_id", F.col("class").alias("code"))


@query("a30_codebook_usage", f"""WITH {_PROTO}, book AS (SELECT class AS code, vec FROM proto UNION ALL SELECT 99, list_transform(range(0, 64), lambda x: 0.125) UNION ALL SELECT 100, list_transform(range(0, 64), lambda x: CASE WHEN x < 2 THEN -5.0 ELSE 0.0 END)),
a AS (SELECT vec_id, code FROM (SELECT vec_id, code, row_number() OVER (PARTITION BY vec_id ORDER BY list_cosine_similarity(embedding::DOUBLE[], vec) DESC, code) AS r FROM embeddings, book) WHERE r = 1),
u AS (SELECT code, pos, count(*) AS n, avg(v) AS m FROM (SELECT code, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM embeddings JOIN a USING (vec_id)) GROUP BY ALL),
o AS (SELECT code, unnest(range(0, 64)) AS pos, unnest(vec) AS old FROM book)
SELECT o.code, o.pos::INT AS pos, coalesce(n, 0)::BIGINT AS used, round(CASE WHEN n IS NULL THEN old ELSE 0.99 * old + 0.01 * m END, 6) + 0.0 AS v FROM o LEFT JOIN u USING (code, pos)""")
def _(t):
    """Usage counts and the moving average of the codes; a code that nothing chose keeps its vector."""
    far = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i < 2, -5.0).otherwise(0.0))
    one = t.spark.range(1)
    more = one.select(F.lit(99).alias("code"), F.array_repeat(F.lit(0.125), 64).alias("vec")).unionByName(one.select(F.lit(100).alias("code"), far.alias("vec")))
    book = prototypes(t).select(F.col("class").alias("code"), "vec").unionByName(more)
    new = matrices.update_codebook(t.embeddings, "embedding", book, 0.99)
    return new.select("code", "used", F.posexplode("vec").alias("pos", "v")).select("code", "pos", "used", (R("v") + 0.0).alias("v"))


@query("a33_global_stats", "SELECT vec_id, round(list_avg(embedding::DOUBLE[]), 6) AS mean, round(greatest(list_stddev_samp(embedding::DOUBLE[]), 1e-8), 6) AS std FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", R(vec.mean("embedding")).alias("mean"), R(F.greatest(vec.std("embedding", True), F.lit(1e-8))).alias("std"))


def _per_value(name: str, f, sql: str):
    query(name, f"SELECT vec_id, unnest(range(0, len(x)))::INT AS pos, round(unnest(x), 6) + 0.0 AS v FROM (SELECT vec_id, {sql} AS x FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings))")(lambda t: _long(t.embeddings.select("vec_id", f(F.col("embedding")).alias("x")), "x", "vec_id"))


_per_value("n1_l2_normalize", vec.l2_normalize, "list_transform(e, lambda v: v / greatest(sqrt(list_dot_product(e, e)), 1e-12))")
_per_value("n3_zscore_pop", vec.zscore_pop, "list_transform(e, lambda v: (v - list_avg(e)) / list_stddev_pop(e))")
_per_value("n4_zscore_sample", vec.zscore_sample, "list_transform(e, lambda v: (v - list_avg(e)) / greatest(list_stddev_samp(e), 1e-8))")
_per_value("n4_scale_std", vec.scale_std, "list_transform(e, lambda v: v / greatest(list_stddev_samp(e), 1e-8))")
_per_value("n7_instance_norm", lambda c: vec.instance_norm(c)["values"], "list_transform(e, lambda v: (v - list_avg(e)) / sqrt(list_var_pop(e) + 1e-5))")
_per_value("n12_softmax", vec.softmax, "list_transform(e, lambda v: exp(v) / list_sum(list_transform(e, lambda u: exp(u))))")
_per_value("n10_linear_resample_32", lambda c: vec.linear_resample(c, 32), "list_transform(range(0, 32), lambda i: e[2 * i + 1] + (e[2 * i + 2] - e[2 * i + 1]) * 0.5)")
_per_value("n10_linear_resample_100", lambda c: vec.linear_resample(c, 100), "list_transform(list_transform(range(0, 100), lambda i: greatest((i + 0.5) * 64.0 / 100 - 0.5, 0)), lambda s: e[least(floor(s), 63)::INT + 1] + (e[least(least(floor(s), 63) + 1, 63)::INT + 1] - e[least(floor(s), 63)::INT + 1]) * (s - least(floor(s), 63)))")
_per_value("w3_cut_choice", lambda c: windows.cut_choice(c, 16, uniform(5, "vec_id")).cast("array<double>"), "list_slice(e, floor(('0x' || substr(md5(concat_ws('|', '5', vec_id)), 1, 8))::BIGINT / 4294967296.0 * 49)::INT + 1, floor(('0x' || substr(md5(concat_ws('|', '5', vec_id)), 1, 8))::BIGINT / 4294967296.0 * 49)::INT + 16)")
_per_value("w4_tile_and_truncate", lambda c: windows.tile_and_truncate(c, 150).cast("array<double>"), "list_slice(list_concat(list_concat(e, e), e), 1, 150)")
_per_value("p5_first_48", lambda c: F.slice(c, 1, 48).cast("array<double>"), "list_slice(e, 1, 48)")
_per_value("p20_select_channels", lambda c: clean.select_channels(c, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("C"), i.cast("string"))), ["C5", "C63", "C0"]).cast("array<double>"), "[e[6], e[64], e[1]]")
_per_value("p22_drop_channels", lambda c: clean.drop_channels(c, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(F.lit("C"), i.cast("string"))), ["C1", "C62"]).cast("array<double>"), "list_concat(list_concat([e[1]], list_slice(e, 3, 62)), [e[64]])")
_per_value("d4_dft_amplitude", vec.dft_amplitude, "list_transform(range(0, 33), lambda k: sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * cos(2 * pi() * i * k / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * sin(2 * pi() * i * k / 64))), 2)))")
_per_value("d7_autocorrelation", vec.circular_autocorrelation, "list_transform(range(0, 64), lambda k: list_sum(list_transform(range(0, 64), lambda i: e[(i + k) % 64 + 1] * e[i + 1])))")


@query("n6_amplitude_jitter", "SELECT vec_id, unnest(range(0, 64))::INT AS pos, round(unnest(list_transform(embedding::DOUBLE[], lambda v: v * (0.9 + 0.2 * (('0x' || substr(md5(concat_ws('|', '11', vec_id)), 1, 8))::BIGINT / 4294967296.0)))), 6) AS v FROM embeddings")
def _(t):
    return _long(t.embeddings.select("vec_id", vec.amplitude_jitter("embedding", uniform(11, "vec_id"), 0.9, 1.1).alias("x")), "x", "vec_id")


@query("n5_normalize_by_split", """SELECT vec_id, unnest(range(0, 64))::INT AS pos, round(unnest(CASE WHEN vec_id % 10 = 9 THEN list_transform(e, lambda v: (v - list_avg(e)) / greatest(list_stddev_samp(e), 1e-8)) WHEN label % 2 = 0 THEN list_transform(e, lambda v: v / greatest(list_stddev_samp(e), 1e-8)) ELSE e END), 6) AS v FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)""")
def _(t):
    method = F.when(F.col("vec_id") % 10 == 9, "zscore_global").when(F.col("label") % 2 == 0, "scale_std").otherwise("none")
    return _long(t.embeddings.select("vec_id", vec.normalize_named("embedding", method).alias("x")), "x", "vec_id")


def _normal_sql() -> str:
    """SQL of all ways to normalise a signal of four channels, and the one that a hash picks."""
    z = "list_transform({c}, lambda v: (v - list_avg({s})) / greatest(list_stddev_samp({s}), 1e-8))"
    d = "list_transform({c}, lambda v: v / greatest(list_stddev_samp({s}), 1e-8))"
    forms = ["c", z.format(c="c", s="e"), d.format(c="c", s="e"), z.format(c="c", s="c"), d.format(c="c", s="c")]
    pick = f"floor({hashed(9, 'vec_id')} * 5)"
    chosen = "CASE " + " ".join(f"WHEN {pick} = {i} THEN {f}" for i, f in enumerate(forms)) + " END"
    return f"""WITH x AS (SELECT vec_id, k, embedding::DOUBLE[] AS e, list_slice(embedding::DOUBLE[], k * 16 + 1, k * 16 + 16) AS c FROM embeddings, range(0, 4) r(k))
SELECT vec_id, k::INT AS channel, unnest(range(0, 16))::INT AS pos, round(unnest({forms[1]}), 6) + 0.0 AS zscore_global, round(unnest({forms[2]}), 6) + 0.0 AS std_global, round(unnest({forms[3]}), 6) + 0.0 AS zscore_channel, round(unnest({forms[4]}), 6) + 0.0 AS std_channel, round(unnest({chosen}), 6) + 0.0 AS random FROM x"""


@query("n5_normalize_signal", _normal_sql())
def _(t):
    """Global and channel forms of a signal of four channels, and one picked by the row's key."""
    e = F.col("embedding").cast("array<double>")
    names = ["zscore_global", "std_global", "zscore_channel", "std_channel", "random"]
    df = t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice(e, c * 16 + 1, F.lit(16))).alias("s"))
    df = df.select("vec_id", *(vec.normalize_signal("s", n, 9, "vec_id").alias(n) for n in names))
    rows = df.select("vec_id", F.posexplode(F.arrays_zip(*names)).alias("channel", "z"))
    rows = rows.select("vec_id", "channel", F.posexplode(F.arrays_zip(*(F.col(f"z.{n}").alias(n) for n in names))).alias("pos", "v"))
    return rows.select("vec_id", "channel", "pos", *((R(f"v.{n}") + 0.0).alias(n) for n in names))


@query("n2_norm_dot_cosine", "SELECT a.vec_id, round(sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS norm, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    b = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"))
    return t.embeddings.join(b, "vec_id").select("vec_id", R(vec.norm("embedding")).alias("norm"), R(vec.dot("embedding", "o")).alias("dot"), R(vec.cosine("embedding", "o")).alias("cosine"))


@query("n12_argmax", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", vec.argmax("embedding").alias("best"))


@query("n14_norm_check", "SELECT count(*)::BIGINT AS n, count(*) FILTER (abs(x - 1) > 1e-4)::BIGINT AS off, abs(avg(x) - 1) <= 1e-3 AS ok FROM (SELECT sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS x FROM embeddings)")
def _(t):
    x = vec.norm("embedding")
    return t.embeddings.agg(F.count("*").alias("n"), F.count_if(F.abs(x - 1) > 1e-4).alias("off"), (F.abs(F.avg(x) - 1) <= 1e-3).alias("ok"))


@query("n15_self_similarity", f"WITH {_PROTO} SELECT vec_id, round(max(sim) FILTER (rank = 1), 6) AS top, round(coalesce(max(sim) FILTER (rank = 2), 0), 6) AS second, round(coalesce(max(sim) FILTER (rank = 11), 0), 6) AS eleventh, bool_or(rank = 1 AND class = label) AS is_highest FROM ranked GROUP BY vec_id")
def _(t):
    at = lambda k: R(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("sim"))), F.lit(0.0)))
    return ranked(t, 11).groupBy("vec_id").agg(at(1).alias("top"), at(2).alias("second"), at(11).alias("eleventh"), F.bool_or((F.col("rank") == 1) & (F.col("class") == F.col("label"))).alias("is_highest"))


@query("n16_one_hot", "SELECT vec_id, pos::INT AS pos, (pos = label)::INT AS v FROM embeddings, range(0, 10) r(pos)")
def _(t):
    return t.embeddings.select("vec_id", F.posexplode(vec.one_hot("label", 10)).alias("pos", "v"))


@query("d6_dominant_frequencies", """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), a AS (SELECT vec_id, k, sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * cos(2 * pi() * i * k / 64))), 2) + pow(list_sum(list_transform(range(0, 64), lambda i: e[i + 1] * sin(2 * pi() * i * k / 64))), 2)) AS amp FROM e, range(1, 32) r(k))
SELECT vec_id, k::INT AS bin, r::INT AS rank, round(amp, 6) AS amplitude FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(amp, 9) DESC, k) AS r FROM a) WHERE r <= 3""")
def _(t):
    """The three strongest bins of each vector, without the mean and the Nyquist bin."""
    from pyspark.sql import Window

    a = t.embeddings.select("vec_id", F.posexplode(vec.dft_amplitude("embedding")).alias("bin", "amplitude")).where("bin between 1 and 31")
    w = Window.partitionBy("vec_id").orderBy(F.round("amplitude", 9).desc(), "bin")
    return a.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("vec_id", "bin", "rank", R("amplitude").alias("amplitude"))


@query("w2_cut_fixed", "SELECT vec_id, piece::INT AS piece, round(list_sum(list_slice(embedding::DOUBLE[], piece * 16 + 1, piece * 16 + 16)), 6) AS s, label FROM embeddings, range(0, 4) r(piece)")
def _(t):
    return windows.cut_fixed(t.embeddings, "embedding", 16).select("vec_id", "piece", R(vec.total("slice")).alias("s"), "label")


@query("w9_sliding_patches", "SELECT vec_id, p::INT AS p, round(list_sum(list_slice(list_concat(e, list_transform(range(0, 8), lambda i: e[64])), p * 8 + 1, p * 8 + 16)), 6) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(0, 8) r(p)")
def _(t):
    made = windows.slices(F.col("embedding").cast("array<double>"), 16, 8, pad=True)
    return t.embeddings.select("vec_id", F.posexplode(made).alias("p", "x")).select("vec_id", "p", R(vec.total("x")).alias("s"))


@query("w1_epoch_fixed", "SELECT vec_id, p::INT AS p, round(list_sum(list_slice(e, p * 8 + 1, p * 8 + 17)), 6) AS s FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), range(0, 6) r(p)")
def _(t):
    """Overlapping epochs with both ends: 17 values every 8."""
    made = windows.slices(F.col("embedding").cast("array<double>"), 17, 8)
    return t.embeddings.select("vec_id", F.posexplode(made).alias("p", "x")).select("vec_id", "p", R(vec.total("x")).alias("s"))


@query("p1_validate_samples", "SELECT count(*) FILTER (ok)::BIGINT AS good, count(*) FILTER (NOT ok)::BIGINT AS bad FROM (SELECT len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v))) AS ok FROM embeddings)")
def _(t):
    good, bad = clean.validate_samples(t.embeddings, "embedding", 64)
    return good.agg(F.count("*").alias("good")).crossJoin(bad.agg(F.count("*").alias("bad")))


@query("p2_vector_issues", "SELECT 'zero' AS issue, count(*)::BIGINT AS n, min(vec_id) AS first_key FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda v: CASE WHEN vec_id % 7 = 0 THEN 0 ELSE v END) AS e FROM embeddings) WHERE sqrt(list_dot_product(e, e)) < 1e-8")
def _(t):
    e = t.embeddings.select("vec_id", F.transform("embedding", lambda v: F.when(F.col("vec_id") % 7 == 0, 0.0).otherwise(v.cast("double"))).alias("e"))
    return clean.vector_issues(e, "e", "vec_id")


@query("p8_require_feature", "SELECT vec_id, list_sum(embedding::DOUBLE[]) <> 0 AS present FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", (vec.total("embedding") != 0).alias("present"))


@query("p9_label_range", "SELECT count(*)::BIGINT AS n, count(*) FILTER (label < 0 OR label > 8)::BIGINT AS outside FROM embeddings")
def _(t):
    return t.embeddings.agg(F.count("*").alias("n"), F.count_if((F.col("label") < 0) | (F.col("label") > 8)).alias("outside"))


@query("p31_target_rate", "SELECT vec_id, len(embedding) = 64 AS same, len(embedding) % 16 = 0 AS multiple FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", (F.size("embedding") == 64).alias("same"), (F.size("embedding") % 16 == 0).alias("multiple"))


@query("p29_project_required", "SELECT e.vec_id, coalesce(l.quality, -1)::INT AS quality, coalesce(len(CASE WHEN l.doc_id IS NULL THEN NULL ELSE embedding END), 768)::INT AS width FROM embeddings e LEFT JOIN labels l ON l.doc_id = e.vec_id")
def _(t):
    j = t.embeddings.join(t.labels, F.col("doc_id") == F.col("vec_id"), "left")
    feature = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("embedding")), F.array_repeat(F.lit(0.0).cast("float"), 768))
    return j.select("vec_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.size(feature).alias("width"))


@query("s3_get_row", "SELECT vec_id, label, len(embedding)::INT AS width FROM embeddings WHERE vec_id = 17")
def _(t):
    return t.embeddings.where("vec_id = 17").select("vec_id", "label", F.size("embedding").alias("width"))


@query("s1_read_samples", "SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", "label", R(F.get("embedding", 0).cast("double")).alias("first"))


@query("j7_candidate_restrict", "SELECT vec_id, label FROM embeddings WHERE label IN (2, 4)")
def _(t):
    wanted = t.embeddings.where(F.col("label").isin(2, 4, 77)).select("label").distinct()
    return t.embeddings.select("vec_id", "label").join(wanted, "label", "left_semi")


@query("j12_index_self_join", "SELECT a.vec_id, coalesce(b.vec_id, a.vec_id) AS source FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id * 2")
def _(t):
    b = t.embeddings.select((F.col("vec_id") / 2).alias("h"), F.col("vec_id").alias("o"))
    return t.embeddings.join(b, F.col("vec_id").cast("double") == F.col("h"), "left").select("vec_id", F.coalesce("o", "vec_id").alias("source"))


@query("r7_undersample", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '3', vec_id))) AS r FROM embeddings), (SELECT min(c) AS m FROM (SELECT count(*) AS c FROM embeddings GROUP BY label)) WHERE r <= m")
def _(t):
    return sampling.resample_groups(t.embeddings.select("vec_id", "label"), "label", "vec_id", "under", 3)


@query("r8_oversample", """WITH b AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '3', vec_id))) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings), m AS (SELECT max(n) AS mx FROM b)
SELECT vec_id, label, c AS copy FROM b, m, range(0, 1000) t(c) WHERE c < mx // n OR (c = mx // n AND r <= mx - n * (mx // n))""")
def _(t):
    return sampling.resample_groups(t.embeddings.select("vec_id", "label"), "label", "vec_id", "over", 3)


@query("r14_draw_with_replacement", "WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT draw, floor(('0x' || substr(md5(concat_ws('|', '9', draw)), 1, 8))::BIGINT / 4294967296.0 * n)::BIGINT AS i FROM range(0, 3000) r(draw), n) SELECT draw, vec_id FROM d JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) USING (i)")
def _(t):
    return sampling.draw_with_replacement(t.embeddings.select("vec_id"), "vec_id", 3000, 9).select("draw", "vec_id")


@query("r16_sequential_id", "SELECT vec_id, format('sample_{}_{:06d}', label, row_number() OVER (PARTITION BY label ORDER BY vec_id)) AS eid FROM embeddings")
def _(t):
    return sampling.sequential_id(t.embeddings, "label", "vec_id", "sample").select("vec_id", "eid")


@query("a23_distinct_classes", "SELECT DISTINCT label FROM embeddings")
def _(t):
    return t.embeddings.select("label").distinct()


@query("a24_label_bounds", "SELECT min(label) AS id_min, max(label) AS id_max, count(DISTINCT label)::BIGINT AS n_class FROM embeddings")
def _(t):
    return t.embeddings.agg(F.min("label").alias("id_min"), F.max("label").alias("id_max"), F.countDistinct("label").alias("n_class"))


@query("o3_shuffle_rows", "SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '13', vec_id)))::INT AS place FROM embeddings")
def _(t):
    from pyspark.sql import Window

    from ..functions.rnd import md5_key

    return t.embeddings.select("vec_id", F.row_number().over(Window.partitionBy("label").orderBy(md5_key(13, "vec_id"))).alias("place"))


@query("o4_argmax_by", "SELECT label, arg_max(vec_id, embedding[1]) AS best, arg_min(vec_id, embedding[1]) AS worst FROM embeddings GROUP BY label")
def _(t):
    x = F.get("embedding", 0)
    return t.embeddings.groupBy("label").agg(F.max_by("vec_id", x).alias("best"), F.min_by("vec_id", x).alias("worst"))


def _context_sql(hits: str) -> str:
    """SQL of the contexts of hits h(vec_id, class, type, rank)."""
    return f"""WITH {_PROTO}, h AS ({hits}), l AS (SELECT vec_id, type, 'If task is ' || type || ': ' || string_agg(class::VARCHAR, ' | ' ORDER BY rank) AS t FROM h GROUP BY vec_id, type)
SELECT vec_id, string_agg(t, chr(10) ORDER BY o) AS context FROM (SELECT *, md5(concat_ws('|', '21', vec_id, type)) AS o FROM l) GROUP BY vec_id"""


def _context(t: Tables, k: int, **how) -> DataFrame:
    g = prototypes(t).withColumn("type", F.col("class") % 3)
    h = retrieval.retrieve(t.embeddings.select("vec_id", "embedding"), g, k, "embedding", "vec", ["vec_id"], "type", "class", ["class"], **how)
    return retrieval.label_text(h, ["vec_id"], "type", "class", 21)


@query("c5_retrieve_context", _context_sql("SELECT vec_id, class, class % 3 AS type, rank FROM ranked WHERE rank <= 4"))
def _(t):
    return _context(t, 4)


@query("c5_retrieve_of_type", _context_sql("SELECT vec_id, class, 2 AS type, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM sims WHERE class % 3 = 2 QUALIFY rank <= 2"))
def _(t):
    return _context(t, 2, only=2)


@query("c5_retrieve_candidates", _context_sql("SELECT vec_id, class, class % 3 AS type, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) AS rank FROM sims WHERE class IN (1, 3, 7) QUALIFY rank <= 2"))
def _(t):
    """Candidates come before a type; an unknown one is passed over."""
    wanted = prototypes(t).select("class").where("class in (1, 3, 7)").unionByName(t.spark.range(1).select(F.lit(99).alias("class")))
    return _context(t, 2, only=2, candidates=wanted)


@query("c5_retrieve_with_quota", _context_sql("SELECT vec_id, class, class % 3 AS type, row_number() OVER (PARTITION BY vec_id ORDER BY (n > 1)::INT, sim DESC, class) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, class % 3 ORDER BY sim DESC, class) AS n FROM sims) WHERE n = 1 OR (class % 3 = 0 AND n <= 3)"))
def _(t):
    """No type: the best of each of three types, and the next two of one."""
    return _context(t, 5, fill=0)


@query("c9_store_audit", "SELECT label, count(*)::BIGINT AS n, count(*) FILTER (NOT list_bool_and(list_transform(embedding, lambda v: isfinite(v))))::BIGINT AS bad, count(*) FILTER (abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 1e-4)::BIGINT AS off_norm, round(min(list_stddev_pop(embedding::DOUBLE[])), 6) AS least_std FROM embeddings GROUP BY label")
def _(t):
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n"), F.count_if(~vec.is_finite("embedding")).alias("bad"), F.count_if(F.abs(vec.norm("embedding") - 1) > 1e-4).alias("off_norm"), R(F.min(vec.std("embedding"))).alias("least_std"))


@query("c7_balanced_training_view", """WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, vec_id % 3 AS d FROM embeddings WHERE vec_id % 10 < 9 AND vec_id % 3 <> 2),
f AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY md5(concat_ws('|', '4', vec_id)), vec_id) AS k FROM s), g AS (SELECT * FROM f WHERE k <= 100),
w AS (SELECT label, n, sum(n) OVER () AS t, count(*) OVER () AS c, max(n) OVER () AS mx FROM (SELECT label, count(*) AS n FROM g GROUP BY label)),
u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '4', vec_id)), vec_id) AS r FROM g)
SELECT vec_id, label, copy, round(t::DOUBLE / (c * n), 6) AS class_weight, round(list_avg(list_transform(e, lambda v: abs((v - list_avg(e)) / greatest(list_stddev_samp(e), 1e-8)))), 6) AS mad
FROM u JOIN w USING (label), range(0, 1000) q(copy) WHERE copy < mx // n OR (copy = mx // n AND r <= mx - n * (mx // n))""")
def _(t):
    """Partitions, seeded limit, required columns, class weights, over-sampling, normalisation by split."""
    from .pipelines import View, training_view

    store = t.embeddings.select("vec_id", "label", "embedding", F.concat(F.lit("d"), (F.col("vec_id") % 3).cast("string")).alias("dataset"), sampling.split_modulo("vec_id").alias("split"))
    how = View(exclude=("d2",), limit=100, required=("embedding", "label"), strategy="over", methods={"train": "zscore_global"}, seed=4)
    view = training_view(store, "vec_id", how, "embedding")
    return view.select("vec_id", "label", "copy", R("class_weight").alias("class_weight"), R(vec.mean(F.transform("embedding", lambda v: F.abs(v)))).alias("mad"))
