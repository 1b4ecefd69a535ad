"""Conversations to padded training batches: one job of filters, split, retrieval context, placeholders, prompt, labels, order and padding."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.rnd import uniform
from ..operators import instruct, sampling
from ..operators.ordered import small
from ..sources.shared import saved
from .registry import query
from .tables import hashed

MARK_ID = -200


def word_ids(text: Column) -> Column:
    """Ids of words by hash, MARK_ID for the placeholder: stands where no tokenizer is given."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.when(w == "<image>", MARK_ID).otherwise((F.crc32(w.cast("binary")) % 30_000 + 10).cast("int")))


@dataclass
class Preparation:
    """How conversations become batches. keyword: conversations whose image path holds it go; images_only: those without an image go; train: share
    of the first conversations by key that are the train split, the rest the other; context_rate: share of conversations with an image that
    get their context; style, system, sep, sep2: of the prompt; tokens: ids of a turn's text; roles: human, assistant."""

    keyword: str | None = None
    images_only: bool = False
    train: float = 0.999
    split: str = "train"
    context_rate: float = 0.015
    wrap: tuple[str, str] | None = None
    style: str = "single"
    system: str = ""
    sep: str = "###"
    sep2: str = ""
    tokens: Callable[[Column], Column] = word_ids
    roles: tuple[str, str] = ("user", "assistant")
    megabatch: int = 64
    longest: int = 2048
    pad_id: int = 0
    pad_ends: bool = False
    seed: int = 0


def prepare(turns: DataFrame, how: Preparation, contexts: DataFrame | None = None) -> DataFrame:
    """(conv, megabatch, place, prompt, ids, labels, mask) of turns(conv, turn, role, text, image): image is the conversation's path or null, on every
    turn of it. contexts(conv, context): retrieval text, asked for by a share of the conversations with an image.

    A first turn that isn't the human's goes; conversations without turns left give no row. Null texts are empty."""
    df = turns.select("conv", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "image")
    if how.images_only:
        df = df.where(F.col("image").isNotNull())
    if how.keyword is not None:
        df = df.where(~F.coalesce(F.contains("image", F.lit(how.keyword)), F.lit(False)))
    df = instruct.drop_leading(df, "conv", "turn", "role", how.roles[0])
    convs = saved(sampling.split_tail(df.groupBy("conv").agg(F.max("image").alias("image")), "conv", how.train).where(F.col("split") == how.split).select("conv"), "split")
    df = df.join(convs.hint("merge"), "conv", "left_semi")
    human = F.col("role") == how.roles[0]
    marked = F.col("image").isNotNull() & F.contains("text", F.lit("<image>"))
    df = df.withColumn("text", F.when(marked, X.strip_placeholder("text", uniform(f"{how.seed}m", "conv", "turn") < 0.5)).otherwise(F.col("text")))
    if contexts is not None:
        chosen = contexts.where(uniform(f"{how.seed}c", "conv") < how.context_rate)
        df = df.join(small(chosen.select("conv", "context")), "conv", "left")
        nth = F.sum(human.cast("int")).over(Window.partitionBy("conv").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))
        context = F.when(human & (nth == 1) & F.col("image").isNotNull(), F.col("context"))
        df = df.withColumn("_ask", context)
        df = df.withColumn("text", X.ask_with("text", F.col("_ask"), uniform(f"{how.seed}f", "conv") < 0.5)).drop("_ask", "context")
    if how.wrap:
        df = df.withColumn("text", F.when(F.col("image").isNotNull(), F.replace("text", F.lit("<image>"), F.lit(how.wrap[0] + "<image>" + how.wrap[1]))).otherwise(F.col("text")))
    images = df.groupBy("conv").agg(F.bool_or(F.col("image").isNotNull()).alias("_image"))
    packed = instruct.collect_turns(df, "conv", "turn", "role", "text").join(images.hint("merge"), "conv")
    ids = F.transform("turns", lambda t: how.tokens(t["text"]))
    made = packed.select("conv", "_image", X.render_prompt("turns", how.style, F.lit(how.system), how.sep, how.sep2).alias("prompt"), "turns", ids.alias("_ids"))
    made = made.select("conv", "_image", "prompt", F.flatten("_ids").alias("ids"), instruct.loss_mask("turns", "_ids", how.roles[1]).alias("labels"))
    made = saved(made.withColumn("_length", F.size("ids")), "prepared")
    order = instruct.modality_order(made.select("conv", "_length", "_image"), "conv", "_length", F.col("_image"), how.megabatch, how.seed).select("conv", "megabatch", "place")
    batches = made.join(order.hint("merge"), "conv")
    padded = instruct.pad_batch(batches, "megabatch", "conv", "ids", "labels", how.pad_id, how.longest, MARK_ID, pad_ends=how.pad_ends)
    return padded.join(batches.select("conv", "place", "prompt"), "conv").select("conv", "megabatch", "place", "prompt", "ids", "labels", "mask")


_ORDER = """{name} AS (SELECT k, m, n, (row_number() OVER (PARTITION BY m ORDER BY md5(concat_ws('|', '{seed}', k)), k) - 1) // {size} AS b, count(*) OVER (PARTITION BY m) AS c FROM {rows}),
{name}2 AS (SELECT *, row_number() OVER (PARTITION BY m, b ORDER BY n DESC, k) - 1 AS place, b = ceil(c / {size}.0) - 1 AS tail FROM {name}),
{name}3 AS (SELECT m, b, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', m::VARCHAR, b)), m, b) - 1 AS to_ FROM (SELECT DISTINCT m, b FROM {name}2 WHERE NOT tail)),
{name}4 AS (SELECT k, coalesce(to_, (SELECT count(*) FROM {name}3)) AS megabatch, CASE WHEN tail THEN row_number() OVER (PARTITION BY tail ORDER BY k) - 1 ELSE place END AS place FROM {name}2 LEFT JOIN {name}3 USING (m, b))"""


def order_sql(name: str, rows: str, seed: int, size: int) -> str:
    """SQL of {name}4(k, megabatch, place) from rows(k, m, n): key, whether it has an image, length."""
    return _ORDER.format(name=name, rows=rows, seed=seed, size=size)


@query("w10_modality_order", f"WITH r AS (SELECT doc_id AS k, doc_id % 3 = 0 AS m, n_chars AS n FROM documents), {order_sql('o', 'r', 5, 64)} SELECT k AS doc_id, megabatch, place FROM o4")
def _(t):
    out = instruct.modality_order(t.documents.select("doc_id", "n_chars"), "doc_id", "n_chars", F.col("doc_id") % 3 == 0, 64, 5)
    return out.select("doc_id", "megabatch", F.col("place").cast("long").alias("place"))


_STRIP = "replace(CASE WHEN {u} < 0.5 THEN '<image>' || chr(10) || {bare} ELSE {bare} || chr(10) || '<image>' END, chr(10) || chr(10), chr(10))"
_BARE = "trim(replace(text, '<image>', ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_PREPARED = f"""WITH s AS (SELECT conv_id, turn, role, CASE WHEN turn = 1 AND conv_id % 3 <> 1 THEN text || '<image>' ELSE text END AS text, CASE WHEN conv_id % 3 <> 1 THEN 'img/' || conv_id % 10 END AS image FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t0 FROM conversations)),
f AS (SELECT * FROM s WHERE NOT coalesce(contains(image, 'img/7'), false)), l AS (SELECT * FROM f QUALIFY NOT (row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AND role <> 'user')),
p AS (SELECT conv_id FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM l)) WHERE r <= floor(n * 0.9)),
m AS (SELECT conv_id, turn, role, image, CASE WHEN image IS NOT NULL AND contains(text, '<image>') THEN {_STRIP.format(u=hashed('4m', 'conv_id, turn'), bare=_BARE)} ELSE text END AS text,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) = 1 AND role = 'user' AND image IS NOT NULL AND {hashed('4c', 'conv_id')} < 0.5 AS ask FROM l JOIN p USING (conv_id)),
q AS (SELECT conv_id, turn, role, image, CASE WHEN NOT ask THEN text WHEN contains(text, '<image>') THEN CASE WHEN {hashed('4f', 'conv_id')} < 0.5 THEN '<image>' || chr(10) || {_BARE} || '. see ' || conv_id ELSE {_BARE} || '. see ' || conv_id || ' <image>' || chr(10) END ELSE text || '. see ' || conv_id END AS text FROM m),
w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: CASE WHEN x = '<image>' THEN 'I' ELSE x END) AS words FROM q),
c AS (SELECT conv_id, 'sys' || '###' || string_agg(CASE WHEN text = '' THEN role || ':' ELSE role || ': ' || text || '###' END, '' ORDER BY turn) AS prompt, flatten(list(words ORDER BY turn)) AS ids,
  flatten(list(CASE WHEN role = 'assistant' THEN words ELSE list_transform(words, lambda x: '-') END ORDER BY turn)) AS labels, bool_or(image IS NOT NULL) AS image FROM w GROUP BY conv_id),
r AS (SELECT conv_id AS k, image AS m, len(ids) AS n FROM c), {order_sql('o', 'r', 4, 16)},
b AS (SELECT conv_id, megabatch, place, prompt, ids, labels, max(len(ids)) OVER (PARTITION BY megabatch) AS w FROM c JOIN o4 ON k = conv_id),
t AS (SELECT *, CASE WHEN w > 60 THEN list_slice(ids, 1, 59) ELSE ids END AS i2, CASE WHEN w > 60 THEN list_slice(labels, 1, 59) ELSE labels END AS l2, CASE WHEN w > 60 THEN 59 ELSE w END AS w2 FROM b),
z AS (SELECT *, CASE WHEN list_contains(ids, 'I') AND NOT list_contains(i2, 'I') THEN list_concat(list_concat(list_slice(i2, 1, 10), ['I']), list_slice(i2, 12, 59)) ELSE i2 END AS i3 FROM t)
SELECT conv_id, megabatch, place, md5(prompt) AS prompt, w2::BIGINT AS width, len(i3)::BIGINT AS n, coalesce(list_position(i3, 'I'), 0)::BIGINT AS mark, len(list_filter(l2, lambda x: x <> '-'))::BIGINT AS answered FROM z"""


@query("c8_prepare_batches", _PREPARED)
def _(t):
    """Conversations, two thirds of them with an image, through the whole job: one image path is filtered, a tenth is held back, half get context."""
    with_image = F.col("conv_id") % 3 != 1
    text = F.when((F.col("turn") == 1) & with_image, F.concat("text", F.lit("<image>"))).otherwise(F.col("text"))
    path = F.when(with_image, F.concat(F.lit("img/"), (F.col("conv_id") % 10).cast("string")))
    turns = t.conversations.select(F.col("conv_id").alias("conv"), "turn", "role", text.alias("text"), path.alias("image"))
    contexts = t.conversations.select(F.col("conv_id").alias("conv")).distinct().withColumn("context", F.concat(F.lit("see "), F.col("conv").cast("string")))
    how = Preparation(keyword="img/7", train=0.9, context_rate=0.5, system="sys", megabatch=16, longest=60, seed=4)
    out = prepare(turns, how, contexts)
    mark = F.array_position("ids", MARK_ID)
    return out.select(F.col("conv").alias("conv_id"), "megabatch", F.col("place").cast("long").alias("place"), F.md5("prompt").alias("prompt"), F.size("ids").cast("long").alias("width"), F.size(F.filter("mask", lambda m: m)).cast("long").alias("n"), mark.cast("long").alias("mark"), F.size(F.filter("labels", lambda x: x != instruct.IGNORE)).cast("long").alias("answered"))
