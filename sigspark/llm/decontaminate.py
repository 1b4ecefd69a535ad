"""Benchmark passages in training texts, by a generalised suffix automaton of the test items' words.

The automaton of all items is built once and broadcast; a task streams a text's words through it and knows, at each word,
the longest run ending there that some item contains. Runs of at least a window mark their words; an item shorter than a
window marks a run that ends with the whole item. Only stretches of word pairs that the items have at all are
streamed (found with numpy): no match of two words or more can leave such a stretch.

The automaton's size is bounded by max_words item words at a time; items beyond it are matched in further passes, one after
the other, and their marks merged document by document. Once built, an automaton is a few numpy arrays.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblock import ALNUM, Chunk, SpanHashes, chunks, mix, words

TABLE = 1 << 20
#: Steps of the automaton that a task keeps in a dict.
KEPT_STEPS = 1 << 18


@dataclass
class Automaton:
    """Generalised suffix automaton over word hashes, while it is built."""

    window: int
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        if w in step[last]:
            q = step[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q)
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for its strings of at most length[p] + 1 words."""
        twin = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = twin
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = twin
            p = self.link[p]
        return twin

    def build(self, items: list[tuple[str, list[int]]]) -> States:
        """items: id and word hashes. Items without words are left out; those of one word need no automaton."""
        many = [(i, seq) for i, seq in items if len(seq) > 1]
        for _, seq in many:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        n = len(self.step)
        # The state of a run's last `window` words, for states of longer runs.
        order = sorted(range(n), key=self.length.__getitem__)
        top = np.arange(n)
        for s in order:
            if s and self.length[self.link[s]] >= self.window:
                top[s] = top[self.link[s]]
        size = np.array([len(x) for x in self.step])
        at = np.repeat(np.arange(n), size)
        word = np.fromiter((w for x in self.step for w in x), np.uint64, int(size.sum()))
        to = np.fromiter((t for x in self.step for t in x.values()), np.int64, int(size.sum()))
        self.step = []
        vocabulary = np.unique(word)
        edge = at * max(1, len(vocabulary)) + np.searchsorted(vocabulary, word)
        sort = np.argsort(edge)
        pairs = [pair_hashes(np.array(seq, np.uint64)) for _, seq in many]
        single: dict[int, set[str]] = {}
        for i, seq in items:
            if len(seq) == 1:
                single.setdefault(seq[0], set()).add(i)
        made = States(
            self.window, min([self.window, *(len(seq) for _, seq in many)]), vocabulary, edge[sort], to[sort].astype(np.int32), np.array(self.link, np.int32),
            np.array(self.length, np.int32), top.astype(np.int32), np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.uint64), single, {}, {},
        )
        for i, seq in many:
            state, run = made.walk(np.array(seq, np.uint64))
            if len(seq) < self.window:
                made.ends.setdefault(int(state[-1]), []).append((len(seq), i))
            else:
                for s in np.unique(made.top[state[run >= self.window]]).tolist():
                    made.items.setdefault(s, set()).add(i)
        return made


@dataclass
class States:
    """A finished automaton. edges: state x vocabulary + word, sorted, with the states they lead to; top: the state of a
    run's last window words; ends: items shorter than a window by the state of their end; items: the others by top state."""

    window: int
    least: int
    vocabulary: np.ndarray
    edges: np.ndarray
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    top: np.ndarray
    pairs: np.ndarray
    single: dict[int, set[str]]
    ends: dict[int, list[tuple[int, str]]]
    items: dict[int, set[str]]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "walker"}

    @functools.cached_property
    def walker(self) -> dict[int, int]:
        """Steps taken so far, kept by state: texts meet few of the automaton's edges, and those often."""
        return {}

    def _next(self, state: int, word: int) -> int:
        """The state after word (its number in the vocabulary), or -1."""
        key = state * len(self.vocabulary) + word
        if (to := self.walker.get(key)) is None:
            at = int(np.searchsorted(self.edges, key))
            to = int(self.targets[at]) if at < len(self.edges) and self.edges[at] == key else -1
            if len(self.walker) >= KEPT_STEPS:
                self.walker.clear()
            self.walker[key] = to
        return to

    def walk(self, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """After each word: the state, and the length of the longest run ending there that an item contains."""
        states, runs = np.zeros(len(seq), np.int64), np.zeros(len(seq), np.int64)
        if not len(self.vocabulary):
            return states, runs
        place = np.minimum(np.searchsorted(self.vocabulary, seq), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == seq
        state = n = 0
        for k, (w, good) in enumerate(zip(place.tolist(), known.tolist())):
            if not good:
                state = n = 0
                continue
            to = self._next(state, w)
            while to < 0 and state:
                state = int(self.link[state])
                n = int(self.length[state])
                to = self._next(state, w)
            if to >= 0:
                state, n = to, n + 1
            states[k], runs[k] = state, n
        return states, runs

    def short(self, state: int) -> Iterator[tuple[int, str]]:
        """Items shorter than a window that end where a run of this state does."""
        while state > 0:
            yield from self.ends.get(state, ())
            state = int(self.link[state])


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:], 41)


class Matcher:
    """An automaton with the tables that find its stretches in a chunk."""

    def __init__(self, automaton: States):
        self.a = automaton
        self.singles = np.array(sorted(automaton.single), np.uint64)
        self.pair_table = self._table(automaton.pairs)
        self.single_table = self._table(self.singles)

    @staticmethod
    def _table(keys: np.ndarray) -> np.ndarray:
        out = np.zeros(TABLE, bool)
        out[(keys % np.uint64(TABLE)).astype(np.int64)] = True
        return out

    @staticmethod
    def _among(h: np.ndarray, table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        hit = table[(h & np.uint64(TABLE - 1)).astype(np.int64)]
        at = np.flatnonzero(hit)
        hit[at] = keys[np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)] == h[at] if len(keys) else False
        return hit

    def match(self, h: np.ndarray, first: np.ndarray) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For each row with a hit: its words' marks and the items found. h: word hashes; first: bounds of rows."""
        out: dict[int, tuple[np.ndarray, set[str]]] = {}

        def mark(row: int, a: int, b: int, items) -> None:
            if row not in out:
                out[row] = (np.zeros(first[row + 1] - first[row], bool), set())
            out[row][0][a - first[row] : b - first[row]] = True
            out[row][1].update(items)

        if len(self.singles):
            for at in np.flatnonzero(self._among(h, self.single_table, self.singles)):
                mark(int(np.searchsorted(first, at, "right")) - 1, at, at + 1, self.a.single[int(h[at])])
        if len(h) > 1 and len(self.a.pairs):
            good = np.zeros(len(h) + 1, bool)  # good[k]: words k - 1 and k are a pair of some item
            good[1:-1] = self._among(pair_hashes(h), self.pair_table, self.a.pairs)
            good[first] = False
            edge = np.flatnonzero(good[1:] != good[:-1])
            for a, b in zip(edge[0::2].tolist(), (edge[1::2] + 1).tolist()):  # words a to b - 1 are a stretch
                if b - a >= self.a.least:
                    row = int(np.searchsorted(first, a, "right")) - 1
                    for k, (state, n) in enumerate(zip(*(x.tolist() for x in self.a.walk(h[a:b]))), a + 1):
                        if n >= self.a.window:
                            mark(row, k - n, k, self.a.items[int(self.a.top[state])])
                        if self.a.ends:
                            for m, item in self.a.short(state):
                                if m <= n:
                                    mark(row, k - m, k, (item,))
        return out


def item_words(texts: list[str | None]) -> list[list[int]]:
    out: list[list[int]] = []
    for chunk in chunks(pa.array(texts, pa.string())):
        w = words(chunk, ALNUM)
        h = SpanHashes(chunk).of(w.start, w.end)
        out += [h[a:b].tolist() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist())]
    return out


def automata(benchmark: DataFrame, window: int, max_words: int) -> Iterator[tuple[int, States]]:
    """(number of parts, automaton) for each part of benchmark(item_id, text) of about max_words words, made when it is asked
    for. Only one part's items are at the driver at a time."""
    plain = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // (8 * max_words)))
    for k in range(parts):
        rows = plain.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        yield parts, Automaton(window).build(list(zip([r["item_id"] for r in rows], item_words([r["text"] for r in rows]))))


MATCHES = "doc_id long, key long, n_words long, items array<string>, spans array<struct<first: int, last: int, start: int, stop: int>>"


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - 1).tolist()))


def matches(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Per row of docs(doc_id, text): its words, the items found and the marked spans: first and last word, and code
    points (end exclusive). key is a hash of the text. shared: an automaton's States."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([(n, pa.int32()) for n in ("first", "last", "start", "stop")])))])

    def rows(chunk: Chunk, matcher: Matcher) -> tuple[np.ndarray, list, list]:
        w = words(chunk, ALNUM)
        found = matcher.match(SpanHashes(chunk).of(w.start, w.end), w.first)
        items: list[list[str]] = [[] for _ in range(len(chunk))]
        spans: list[list[dict]] = [[] for _ in range(len(chunk))]
        for r, (marks, ids) in found.items():
            items[r] = sorted(ids)
            a = chunk.offsets[r]
            points = np.concatenate(([0], np.cumsum((chunk.data[a : chunk.offsets[r + 1]] & 0xC0) != 0x80)))
            for i, j in _runs(marks):
                x, y = w.start[w.first[r] + i] - a, w.end[w.first[r] + j] - a
                spans[r].append({"first": i, "last": j, "start": int(points[x]), "stop": int(points[y])})
        return w.count, items, spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value)
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                n, items, spans = rows(chunk, matcher)
                columns = [batch.column(i).slice(chunk.first, len(chunk)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, f.type) for v, f in zip((n, items, spans), list(schema)[2:]))], schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, MATCHES)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = 500_000) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, key (a hash of the text), n_words, n_hit (the number of marked words), items and
    spans, against all items of benchmark(item_id, text).

    Null and empty texts, and texts without words, have no words and no hits; the same holds for items, and an empty
    benchmark marks nothing. Items of one id count as one item; a null item_id is left out. Repeated rows each give a
    result, however many automata the items need. Very long texts are matched whole. An empty table gives an empty
    result. Other columns are not looked at.
    """
    context, scratch = docs.sparkSession.sparkContext, None
    for i, (parts, automaton) in enumerate(automata(benchmark, window, max_words)):
        shared = context.broadcast(automaton)
        found = matches(docs, shared)
        if parts == 1:
            all_spans = found
            break
        scratch = scratch or Scratch(docs.sparkSession, "decontaminate")
        rows = F.lit(1 if i == 0 else 0).cast("long").alias("rows")
        part = scratch.save((found if i == 0 else found.where("size(spans) > 0")).select("*", rows), str(i))
        whole = part if i == 0 else whole.unionByName(part)
        shared.destroy()
    if scratch:
        done = F.array().cast("array<struct<first:int,last:int,start:int,stop:int>>")
        last = lambda a: F.element_at(a, -1)
        longer = lambda a, s: F.struct(last(a)["first"].alias("first"), F.greatest(last(a)["last"], s["last"]).alias("last"), last(a)["start"].alias("start"), F.greatest(last(a)["stop"], s["stop"]).alias("stop"))
        touches = lambda a, s: (F.size(a) > 0) & (last(a)["last"] >= s["first"] - 1)
        merged = F.aggregate(
            F.array_sort(F.flatten(F.collect_list("spans"))), done,
            lambda a, s: F.when(touches(a, s), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(longer(a, s)))).otherwise(F.concat(a, F.array(s))),
        )
        items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
        # Equal rows have equal marks: they are one group, given out as often as the first pass saw them.
        grouped = whole.withColumn("spans", F.when((F.col("rows") == 1) & (F.size("spans") == 0), None).otherwise(F.col("spans"))).groupBy("doc_id", "key", "spans", "items")
        once = grouped.agg(F.max("n_words").alias("n_words"), F.sum("rows").alias("rows"))
        told = once.groupBy("doc_id", "key").agg(F.max("n_words").alias("n_words"), items.alias("items"), merged.alias("spans"), F.sum("rows").alias("rows"))
        all_spans = told.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return all_spans.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), "items", "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """docs without benchmark passages: marked spans leave the text, and a document whose marked share of words
    exceeds max_coverage goes altogether. Clean rows are unchanged; n_chars, where there is one, follows the text.

    Null, empty and wordless texts are clean, and so is every text beside an empty benchmark. Repeated rows each get the same
    treatment; rows of one doc_id (or none) with different texts are judged by their own texts. Very long texts are
    looked at whole. An empty table gives an empty one. All columns stay, whatever their names.
    """
    found = contamination(docs, benchmark, window).where("n_hit > 0").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_words", "n_hit", F.col("spans").alias("_spans"))
    found = Scratch(docs.sparkSession, "decontaminate").save(found, "found")
    # The row is one column here, so none of its names can clash with those of the marks.
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    text = F.col("_row.text").cast("string")
    marked = rows.join(found.hint("merge"), F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left")
    gaps = F.transform(F.sequence(F.lit(0), F.size("_spans")), lambda i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_spans"), i - 1)["stop"]).alias("a"), F.when(i == F.size("_spans"), F.length(text)).otherwise(F.get(F.col("_spans"), i)["start"]).alias("b")))
    clean = F.array_join(F.transform(gaps, lambda g: F.substr(text, g["a"] + 1, g["b"] - g["a"])), "")
    kept = marked.where(F.col("_key").isNull() | (F.col("n_hit") <= max_coverage * F.col("n_words")))
    hit = F.col("_key").isNotNull()
    new = {"text": F.when(hit, clean).otherwise(text), "n_chars": F.when(hit, F.length(clean).cast("long")).otherwise(F.col("_row.n_chars")) if "n_chars" in docs.columns else None}
    return kept.select(*(new[c].alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of documents by benchmark, windows of ten words."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE_OP8 = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i2 AS (SELECT item_id, w, least(10, len(w)) AS n FROM iw WHERE len(w) > 0),
i3 AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM i2),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM i3),
ns AS (SELECT DISTINCT n FROM win),
d2 AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, ns WHERE len(w) >= n),
dwin AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM d2),
hit AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
