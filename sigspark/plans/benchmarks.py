"""Multiple-choice benchmarks: questions drawn from labelled items, and predictions scored as a grid of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rnd import uniform
from ..operators import choices, sampling
from ..operators.ordered import small
from ..sources.shared import saved
from .registry import Tables, query
from .tables import R, hashed


def build_mcq(items: DataFrame, key: str, label: str, counts: list[int], draws: int, seed: int, templates: list[str], prefix: str) -> DataFrame:
    """Questions with each number of options: draws items with replacement for each, dense ids prefix_<count>_000001 ... in the order of draws.
    Columns: id, draw, key, label, question, correct, option_number (as asked for; with fewer labels there are fewer options)."""
    rows = saved(items.select(key, label).where(F.col(label).isNotNull()), "items")
    picked = None
    for c in counts:
        part = sampling.draw_with_replacement(rows, key, draws, seed + c).withColumn("asked", F.lit(c))
        picked = part if picked is None else picked.unionByName(part)
    picked = saved(picked, "draws")
    told = choices.questions(picked, ["asked", "draw"], label, F.col("asked"), seed, templates).drop("option_number", label)
    out = picked.join(told.hint("merge"), ["asked", "draw"])
    ids = sampling.sequential_id(out, "asked", "draw", prefix)
    return ids.select(F.col("eid").alias("id"), "draw", key, label, "question", "correct", F.col("asked").alias("option_number"))


def score_mcq(said: DataFrame, by: list[str], macro: list[str], dataset: str = "dataset", cells: DataFrame | None = None) -> DataFrame:
    """(by, total, accuracy, weighted_accuracy, metric) of said(by, question, correct, output): answers are parsed from outputs and count where
    they are an option's letter and the correct one. weighted_accuracy is the mean over the correct options' names; metric is that for the
    datasets in macro, else accuracy. cells: all combinations wanted; those without rows have total 0 and nulls. One pass over said."""
    options = X.parse_options("question")
    told = said.select(*by, options.alias("_map"), F.upper(F.trim("correct")).alias("_c"), X.parse_answer("output").alias("_a"))
    told = told.select(*by, F.try_element_at("_map", F.col("_c")).alias("_name"), X.valid_answer("_a", "_c", "_map").cast("long").alias("_ok"))
    per = told.groupBy(*by, "_name").agg(F.count("*").alias("_n"), F.sum("_ok").alias("_k"))
    out = per.groupBy(*by).agg(F.sum("_n").alias("total"), (F.sum("_k") / F.sum("_n")).alias("accuracy"), F.avg(F.col("_k") / F.col("_n")).alias("weighted_accuracy"))
    if cells is not None:
        out = cells.join(small(out), by, "left").withColumn("total", F.coalesce("total", F.lit(0)))
    return out.withColumn("metric", F.when(F.col(dataset).isin(macro), F.col("weighted_accuracy")).otherwise(F.col("accuracy")))


_TEMPLATES = ["Which source?", "Where does it come from?", "Name the source."]


def _u(seed: int, key: str) -> str:
    return hashed(seed, key)


def floyd(n: str, k: str, seed: int, key: str, own: str | None = None) -> str:
    """SQL list of min(k, n) distinct numbers below n, without own where that is a number."""
    steps = f"list_transform(range(({n}) - least({k}, {n}), {n}), lambda j: [floor({_u(seed, f'{key}, j')} * (j + 1))::BIGINT, j])"
    got = f"list_reduce({steps}, lambda acc, x: CASE WHEN list_contains(acc, x[1]) THEN list_append(acc, x[2]) ELSE list_append(acc, x[1]) END, []::BIGINT[])"
    return got if own is None else f"list_transform({got}, lambda v: CASE WHEN v >= {own} THEN v + 1 ELSE v END)"


def numbers_sql(table: str, column: str) -> str:
    return f"(SELECT class, row_number() OVER (ORDER BY md5(concat_ws('|', '0', class))) - 1 AS c FROM (SELECT DISTINCT {column} AS class FROM {table} WHERE {column} IS NOT NULL))"


_BUILT = f"""num AS {numbers_sql("documents", "source")}, m AS (SELECT count(*) AS m FROM num), r AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents WHERE source IS NOT NULL),
d AS (SELECT asked, draw, floor(CASE asked WHEN 2 THEN {_u(42, 'draw')} WHEN 4 THEN {_u(44, 'draw')} ELSE {_u(50, 'draw')} END * (SELECT count(*) FROM r))::BIGINT AS i FROM (VALUES (2), (4), (10)) a(asked), range(0, 500) b(draw)),
p AS (SELECT asked, draw, doc_id, source, c FROM d JOIN r USING (i) JOIN num ON class = source),
o AS (SELECT asked, draw, source, class FROM (SELECT asked, draw, source, unnest({floyd('m - 1', 'asked - 1', 40, 'asked, draw', 'c')}) AS c FROM p, m) JOIN num USING (c) UNION ALL SELECT asked, draw, source, source FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY asked, draw ORDER BY md5(concat_ws('|', '41', asked, draw, class))) - 1 AS i FROM o),
q AS (SELECT asked, draw, ['Which source?', 'Where does it come from?', 'Name the source.'][floor({_u(42, 'asked, draw')} * 3)::BIGINT + 1] || string_agg(' (' || chr((65 + i)::INT) || ')' || class, '' ORDER BY i) AS question, max(CASE WHEN class = source THEN chr((65 + i)::INT) END) AS correct FROM s GROUP BY asked, draw),
built AS (SELECT format('q_{{}}_{{:06d}}', asked, draw + 1) AS id, draw, doc_id, source, question, correct, asked AS option_number FROM q JOIN p USING (asked, draw))"""


def _built(t: Tables) -> DataFrame:
    return build_mcq(t.documents, "doc_id", "source", [2, 4, 10], 500, 40, _TEMPLATES, "q")


@query("c3_build_benchmark", f"WITH {_BUILT} SELECT * FROM built")
def _(t):
    """Three numbers of options, 500 draws each, seeded templates, dense ids."""
    return _built(t)


_SAID = "CASE WHEN {u} < 0.4 THEN correct WHEN {u} < 0.8 THEN 'B' ELSE 'none' END"


@query("c4_score_grid", f"""WITH {_BUILT}, a AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'd0' ELSE 'd1' END AS dataset, option_number, k AS topk, source, correct, {_SAID.format(u=_u(3, "id, k"))} AS said FROM built, (VALUES (1), (5)) v(k)),
n AS (SELECT dataset, option_number, topk, source, count(*) AS n, sum((said = correct)::INT) AS k FROM a GROUP BY ALL),
g AS (SELECT dataset, option_number, topk, sum(n)::BIGINT AS total, sum(k) / sum(n) AS accuracy, avg(k / n) AS weighted FROM n GROUP BY ALL),
c AS (SELECT * FROM (VALUES ('d0'), ('d1'), ('d2')) a(dataset), (VALUES (2), (4), (10)) b(option_number), (VALUES (1), (5)) c(topk))
SELECT dataset, option_number, topk, coalesce(total, 0) AS total, round(accuracy, 6) AS accuracy, round(weighted, 6) AS weighted_accuracy, round(CASE WHEN dataset = 'd0' THEN weighted ELSE accuracy END, 6) AS metric FROM c LEFT JOIN g USING (dataset, option_number, topk)""")
def _(t):
    """Predictions of two top-k settings for every question, scored by dataset (one by the mean over names), options and top-k; a dataset
    without predictions keeps its cells."""
    k = t.spark.createDataFrame([(1,), (5,)], "topk int")
    b = saved(_built(t), "built").crossJoin(F.broadcast(k))
    u = uniform(3, "id", "topk")
    output = F.when(u < 0.4, F.concat(F.lit("The answer is ("), "correct", F.lit(")"))).when(u < 0.8, "The answer is (B)").otherwise("don't know")
    said = b.select(F.when(F.col("doc_id") % 3 == 0, "d0").otherwise("d1").alias("dataset"), "option_number", "topk", "question", "correct", output.alias("output"))
    cells = t.spark.createDataFrame([(d, o, c) for d in ("d0", "d1", "d2") for o in (2, 4, 10) for c in (1, 5)], "dataset string, option_number int, topk int")
    out = score_mcq(said, ["dataset", "option_number", "topk"], ["d0"], cells=cells)
    return out.select("dataset", "option_number", "topk", "total", *(R(c).alias(c) for c in ("accuracy", "weighted_accuracy", "metric")))
