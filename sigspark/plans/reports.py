"""Prototype sets and retrieval reports put together from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..functions.rnd import md5_key, uniform
from ..operators import metrics, retrieval
from ..operators.choices import drawn
from ..operators.ordered import small
from ..operators.sampling import first_per, numbered
from ..sources.shared import saved
from .registry import query
from .tables import hashed
from .vectors import _PROTO, R, _long, floyd, numbers_sql


def caption_prototypes(labels: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """(dataset, label_id, caption, feature): one feature for each label's caption, each distinct caption embedded once.
    labels(dataset, label_id, caption)."""
    once = labels.select("caption").distinct().withColumn("feature", embed(F.col("caption")))
    return labels.join(once.hint("merge"), "caption").select("dataset", "label_id", "caption", "feature")


def build_prototypes(parts: dict[str, DataFrame]) -> DataFrame:
    """(type, label, proto_idx, feature) of parts(label, vec) by type; proto_idx counts labels within a type, in order."""
    out = None
    for name, df in sorted(parts.items()):
        part = df.select(F.lit(name).alias("type"), F.col("label").cast("string").alias("label"), (F.row_number().over(Window.partitionBy(F.lit(name)).orderBy("label")) - 1).alias("proto_idx"), F.col("vec").alias("feature"))
        out = part if out is None else out.unionByName(part)
    return out


def retrieval_report(queries: DataFrame, ks: list[int], query_key: str, label: str, vector: str, dataset: str, seed: int) -> DataFrame:
    """(dataset, k, n, top1, top5, balanced, auroc, f1_macro, f1_weighted): each dataset's vectors against its own prototypes, among k classes, the own one and
    seeded others. The last three are those of the choice among all classes, the row of the largest k as well, null in the others.
    Scores are made and written once; all ks are one ranking and one aggregate."""
    protos = retrieval.class_prototypes(queries, label, vector, by=[dataset]).withColumnRenamed(label, "class")
    sims = retrieval.similarity_join(queries.select(query_key, dataset, label, vector), protos, vector, "vec", on=[dataset]).select(query_key, dataset, label, "class", "sim")
    own = F.col("class") == F.col(label)
    order = F.row_number().over(Window.partitionBy(query_key).orderBy(own.desc(), md5_key(seed, query_key, "class")))
    told = saved(sims.withColumn("_m", order), "scores")
    each = told.withColumn("k", F.explode(F.filter(F.array(*(F.lit(k) for k in ks)), lambda k: k >= F.col("_m"))))
    w = Window.partitionBy("k", query_key).orderBy(F.col("sim").desc(), "class")
    hit = each.withColumn("rank", F.row_number().over(w)).where(own)
    per = hit.groupBy(dataset, "k", label).agg(F.count("*").alias("n"), F.count_if(F.col("rank") == 1).alias("c"), F.count_if(F.col("rank") <= 5).alias("c5"))
    rates = per.groupBy(dataset, "k").agg(F.sum("n").alias("n"), (F.sum("c") / F.sum("n")).alias("top1"), (F.sum("c5") / F.sum("n")).alias("top5"), F.avg(F.col("c") / F.col("n")).alias("balanced"))
    area = metrics.auroc_by(told, [dataset, "class"], own, F.round("sim", 9)).groupBy(dataset).agg(F.avg("auroc").alias("auroc"))
    best = told.groupBy(dataset, query_key, label).agg(F.max_by("class", F.struct("sim", -F.col("class"))).alias("predicted"))
    f1 = metrics.f1_by(best, dataset, label, "predicted")
    whole = small(saved(area.join(f1.hint("merge"), dataset).withColumn("k", F.lit(max(ks))), "whole"))
    return rates.join(whole, [dataset, "k"], "left")


def store_audit(samples: DataFrame, key: str, fresh: str | None = None, pictured: tuple[str, ...] = ("thingEEG", "ImageNetEEG"), others: int = 5, share: float = 1.0, seed: int = 0) -> DataFrame:
    """One row a dataset of samples(key, dataset, eeg, feature, image_path): n; mean and std (population) of all its signal values; bad, rows whose signal or
    feature is missing, empty or not finite, which take part in nothing further; flat, signals of a standard deviation of 0.01 or less; off_norm, features whose
    norm is off 1 by over 1e-4; path_wrong, rows with no image path in a dataset of pictured ones, or with one in another.

    With fresh, a column of features made anew of the same texts (rows where it is null are not asked), also asked, the rows drawn by share,
    and not_own, those whose fresh feature is nearer by dot product to one of others seeded features of the store than to its own."""
    flat_signal = F.flatten("eeg")
    good = F.coalesce((F.size(flat_signal) > 0) & (F.size("feature") > 0) & vec.is_finite(flat_signal) & vec.is_finite("feature"), F.lit(False))
    told = samples.withColumn("_good", good).withColumn("_x", F.when(F.col("_good"), flat_signal.cast("array<double>")))
    told = told.withColumn("_m", vec.mean("_x")).withColumn("_s", vec.std("_x")).withColumn("_l", F.size("_x"))
    sample_std = F.col("_s") * F.sqrt(F.col("_l") / (F.col("_l") - 1))
    path = F.coalesce("image_path", F.lit("")) != ""
    mean = F.sum(F.col("_m") * F.col("_l")) / F.sum(F.when(F.col("_good"), F.col("_l")))
    square = F.sum((F.col("_s") * F.col("_s") + F.col("_m") * F.col("_m")) * F.col("_l")) / F.sum(F.when(F.col("_good"), F.col("_l")))
    out = told.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if(~F.col("_good")).alias("bad"), mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
        F.count_if(F.col("_good") & ~F.coalesce(sample_std > 0.01, F.lit(False))).alias("flat"), F.count_if(F.col("_good") & (F.abs(vec.norm("feature") - 1) > 1e-4)).alias("off_norm"),
        F.count_if(F.coalesce(F.col("dataset").isin(list(pictured)), F.lit(False)) != path).alias("path_wrong"),
    )
    if fresh is None:
        return out
    rows = told.where("_good").select(key, "dataset", F.col("feature").cast("array<double>").alias("feature"), F.col(fresh).cast("array<double>").alias("_f"))
    rows = saved(numbered(rows, md5_key(seed, key), "_c", [key]), "audit")
    asked = rows.where(F.col("_f").isNotNull() & (uniform(seed + 1, key) < share))
    draws = drawn(F.lit(rows.count() - 1).cast("long"), others, seed + 2, key)
    met = asked.select("_c", "_f", F.explode(F.transform(draws, lambda v: F.when(v >= F.col("_c"), v + 1).otherwise(v))).alias("_o"))
    met = met.join(rows.select(F.col("_c").alias("_o"), "feature").hint("merge"), "_o")
    best = met.groupBy("_c").agg(F.max(vec.dot("_f", "feature")).alias("_best"))
    own = asked.join(best.hint("merge"), "_c", "left")
    wrong = F.coalesce(vec.dot("_f", "feature") < F.col("_best"), F.lit(False))
    sums = saved(own.groupBy(F.col("dataset").alias("_d")).agg(F.count("*").alias("asked"), F.count_if(wrong).alias("not_own")), "asked")
    return out.join(small(sums), F.col("dataset").eqNullSafe(F.col("_d")), "left").drop("_d").fillna(0, ["asked", "not_own"])


@query("c2_build_prototypes", f"""WITH {_PROTO}, f AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label)
SELECT 'mean' AS type, class::VARCHAR AS label, dense_rank() OVER (ORDER BY class)::INT - 1 AS proto_idx, unnest(range(0, 64))::INT AS pos, round(unnest(vec), 6) + 0.0 AS v FROM proto
UNION ALL SELECT 'first', label::VARCHAR, dense_rank() OVER (ORDER BY label)::INT - 1, unnest(range(0, 64))::INT, round(unnest(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) + 0.0 FROM f""")
def _(t):
    first = first_per(t.embeddings, "label", "vec_id").select("label", vec.l2_normalize("embedding").alias("vec"))
    return _long(build_prototypes({"mean": retrieval.class_prototypes(t.embeddings), "first": first}), "feature", "type", "label", "proto_idx")


@query("c6_retrieval_report", """WITH e AS (SELECT *, vec_id % 3 AS dataset FROM embeddings),
p AS (SELECT dataset, label, pos, avg(v) AS m FROM (SELECT dataset, label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS v FROM e) GROUP BY ALL),
g AS (SELECT dataset, label AS class, list(m ORDER BY pos) AS vec FROM p GROUP BY dataset, label),
s AS (SELECT e.dataset, vec_id, label, class, list_cosine_similarity(embedding::DOUBLE[], vec) AS sim, row_number() OVER (PARTITION BY vec_id ORDER BY (class = label)::INT DESC, md5(concat_ws('|', '17', vec_id, class))) AS m FROM e JOIN g ON e.dataset = g.dataset),
r AS (SELECT k, dataset, vec_id, label, class, row_number() OVER (PARTITION BY k, vec_id ORDER BY sim DESC, class) AS r FROM s, (VALUES (2), (4), (10)) v(k) WHERE m <= k),
a AS (SELECT k, dataset, label, count(*) AS n, sum((r = 1)::INT) AS c, sum((r <= 5)::INT) AS c5 FROM r WHERE class = label GROUP BY ALL),
u AS (SELECT dataset, class, (sum(CASE WHEN label = class THEN k ELSE 0 END) - count(*) FILTER (label = class) * (count(*) FILTER (label = class) + 1) / 2.0) / (count(*) FILTER (label = class) * count(*) FILTER (label <> class)) AS auc
  FROM (SELECT *, rank() OVER (PARTITION BY dataset, class ORDER BY round(sim, 9)) + (count(*) OVER (PARTITION BY dataset, class, round(sim, 9)) - 1) / 2.0 AS k FROM s) GROUP BY ALL),
b AS (SELECT dataset, vec_id, label, class FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, class) = 1),
f AS (SELECT dataset, avg(2.0 * tp / (n + given)) AS f1_macro, sum(2.0 * tp / (n + given) * n) / sum(n) AS f1_weighted FROM (SELECT l.dataset, l.label, count(*) AS n, count(*) FILTER (l.class = l.label) AS tp, (SELECT count(*) FROM b WHERE b.dataset = l.dataset AND b.class = l.label) AS given FROM b l GROUP BY ALL) GROUP BY dataset),
t AS (SELECT dataset, k::INT AS k, sum(n)::BIGINT AS n, round(sum(c)::DOUBLE / sum(n), 6) AS top1, round(sum(c5)::DOUBLE / sum(n), 6) AS top5, round(avg(c::DOUBLE / n), 6) AS balanced FROM a GROUP BY dataset, k)
SELECT t.*, CASE WHEN k = 10 THEN (SELECT round(avg(auc), 6) FROM u WHERE u.dataset = t.dataset) END::DOUBLE AS auroc, CASE WHEN k = 10 THEN round(f1_macro, 6) END AS f1_macro, CASE WHEN k = 10 THEN round(f1_weighted, 6) END AS f1_weighted FROM t JOIN f USING (dataset)""")
def _(t):
    e = t.embeddings.withColumn("dataset", F.col("vec_id") % 3)
    out = retrieval_report(e, [2, 4, 10], "vec_id", "label", "embedding", "dataset", 17)
    return out.select("dataset", "k", "n", *(R(c).alias(c) for c in ("top1", "top5", "balanced", "auroc", "f1_macro", "f1_weighted")))


_NORM = "sqrt(list_dot_product(e, e))"


@query("c9_audit_report", f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, 'd' || (label % 3) AS dataset, CASE WHEN vec_id % 5 = 0 THEN '' ELSE 'p' END AS p FROM embeddings WHERE vec_id % 50 <> 7),
num AS (SELECT vec_id AS class, row_number() OVER (ORDER BY md5(concat_ws('|', '3', vec_id)), vec_id) - 1 AS c FROM v),
w AS (SELECT v.*, c, list_transform(e, lambda x: round(x, 1)) AS f FROM v JOIN num ON vec_id = class),
a AS (SELECT vec_id, dataset, c, e, f, unnest({floyd('m - 1', '5', 5, 'vec_id', 'c')}) AS o FROM w, (SELECT count(*) AS m FROM num) WHERE {hashed(4, 'vec_id')} < 0.5),
b AS (SELECT a.vec_id, a.dataset, max(list_dot_product(a.f, w.e)) > any_value(list_dot_product(a.f, a.e)) AS wrong FROM a JOIN w ON a.o = w.c GROUP BY a.vec_id, a.dataset)
SELECT dataset, (count(*) + (SELECT count(*) FROM embeddings x WHERE x.vec_id % 50 = 7 AND 'd' || (x.label % 3) = v.dataset))::BIGINT AS n,
  (SELECT count(*) FROM embeddings x WHERE x.vec_id % 50 = 7 AND 'd' || (x.label % 3) = v.dataset)::BIGINT AS bad,
  round(avg(list_avg(e[1:32])), 6) + 0.0 AS mean, round(sqrt(avg(list_dot_product(e[1:32], e[1:32])) / 32 - pow(avg(list_avg(e[1:32])), 2)), 6) AS std,
  count(*) FILTER (list_stddev_samp(e[1:32]) <= 0.01)::BIGINT AS flat, count(*) FILTER (abs({_NORM} - 1) > 1e-4)::BIGINT AS off_norm,
  (count(*) FILTER ((dataset = 'd0') <> (p <> '')) + (SELECT count(*) FROM embeddings x WHERE x.vec_id % 50 = 7 AND 'd' || (x.label % 3) = v.dataset AND (v.dataset = 'd0') <> (x.vec_id % 5 <> 0)))::BIGINT AS path_wrong,
  (SELECT count(*) FROM b WHERE b.dataset = v.dataset)::BIGINT AS asked, (SELECT count(*) FROM b WHERE b.dataset = v.dataset AND wrong)::BIGINT AS not_own FROM v GROUP BY dataset""")
def _(t):
    """Half of each vector as a signal of two channels; every 50th row's feature is missing, and the fresh features are rounded ones."""
    e = F.col("embedding").cast("array<double>")
    eeg = F.array(F.slice(e, 1, 16), F.slice(e, 17, 16))
    feature = F.when(F.col("vec_id") % 50 != 7, e)
    path = F.when(F.col("vec_id") % 5 != 0, "p").otherwise("")
    rows = t.embeddings.select("vec_id", F.concat(F.lit("d"), (F.col("label") % 3).cast("string")).alias("dataset"), eeg.alias("eeg"), feature.alias("feature"), path.alias("image_path"), F.transform(e, lambda x: F.round(x, 1)).alias("fresh"))
    out = store_audit(rows, "vec_id", "fresh", ("d0",), 5, 0.5, 3)
    return out.select("dataset", "n", "bad", R("mean").alias("mean"), R("std").alias("std"), "flat", "off_norm", "path_wrong", "asked", "not_own")
