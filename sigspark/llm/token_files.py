"""Token-id output: tokenise whole texts, re-number ids by corpus frequency, and write them in a byte-aligned
variable-length format whose control bytes stand apart from the data bytes; read back by numpy table lookup.

Format of one block (a row of the written Parquet table, so that Spark's committer makes the files whole even when an
executor is lost and the task runs again):

    header   4 little-endian uint32: number of ids, number of control bytes, number of data bytes, 0
    control  one byte for four ids; bits 2k and 2k+1 hold the data length of id k, less 1 (1 to 4 bytes)
    data     each id's frequency rank, little-endian, in as few bytes as its length says

A block also carries its documents' ids and token counts. Blocks are written in ascending doc_id order (range
partitions, sorted within), each with its shard (range partition) and its number in the shard. Ranks go to ids through the
codebook table: rank 0 is the most frequent id, ties by id. Decoding a control byte takes one row of a 256-row table
of lengths; the data offsets are one cumulative sum, and the values four masked gathers. No step is per id.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch
from .textblock import Chunk, chunks, mix, powers

END_ID = 2
BLOCK_IDS = 1 << 18
#: Pre-tokens kept by a task's cache before it starts afresh.
CACHE_ENTRIES = 1 << 21
#: Most bytes of a pre-token that its hash stands for.
LONGEST = 256

_U = np.uint64
# Classes of the byte-level pattern: letter, number, white space, other.
_L, _N, _S, _O = 0, 1, 2, 3


def _class_table() -> np.ndarray:
    import unicodedata

    out = np.full(0x800, _O, np.uint8)
    for c in range(0x800):
        kind = unicodedata.category(chr(c))
        out[c] = _L if kind[0] == "L" else _N if kind[0] == "N" else _S if chr(c).isspace() and c not in (0x1C, 0x1D, 0x1E, 0x1F) else _O
    return out


_RAW_BYTE = mix(np.arange(1, 257, dtype=np.uint64), 11)


class Tokeniser:
    """Token ids of whole chunks with a byte-level tokenizer file of the tokenizers library.

    The library's pre-tokens (contractions, optional space with letters, numbers or other signs, white space) are found with numpy
    for texts of code points below U+0500; each distinct pre-token is encoded by the library once and kept. Texts with
    any other code point, with an added token's string, or with a pre-token of over LONGEST bytes go to the library whole, and
    so do all texts where the file's configuration is another one. Both ways give the library's ids.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.added = [t["content"].encode() for t in config.get("added_tokens", [])]
        split = config.get("pre_tokenizer") or {}
        self.plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not config.get("normalizer") and not config.get("truncation")
        self.table = _class_table()
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(2 * CACHE_ENTRIES, np.uint64)  # open addressing; 0 is free
        self.slots = np.zeros(2 * CACHE_ENTRIES, np.int32)
        self.pool = np.zeros(1 << 16, np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = self.count = 0
        self.begin = np.zeros(CACHE_ENTRIES, np.int32)
        self.size = np.zeros(CACHE_ENTRIES, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        out = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        at = (hashes % _U(len(self.keys))).astype(np.int64)
        while len(left):
            key = self.keys[at]
            hit = key == hashes[left]
            out[left[hit]] = self.slots[at[hit]]
            go = ~hit & (key != 0)
            left, at = left[go], (at[go] + 1) % len(self.keys)
        return out

    def _learn(self, hashes: np.ndarray, tokens: list[str]) -> None:
        ids = [e.ids for e in self.library.encode_batch_fast(tokens, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(itertools.chain.from_iterable(ids), self.pool.dtype, int(size.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.used : self.used + len(flat)] = flat
        slot = np.arange(self.count, self.count + len(ids), dtype=np.int32)
        self.begin[slot] = self.used + np.cumsum(size) - size
        self.size[slot] = size
        self.used += len(flat)
        self.count += len(ids)
        at = (hashes % _U(len(self.keys))).astype(np.int64)
        while len(slot):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]
            mine = self.keys[at] == hashes
            self.slots[at[mine]] = slot[mine]
            hashes, slot, at = hashes[~mine], slot[~mine], (at[~mine] + 1) % len(self.keys)

    def pretokens(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start byte of each pre-token. data: UTF-8 with code points below U+0800 only; rows begin at offsets."""
        n = len(data)
        lead = (data & 0xC0) != 0x80
        point = data.astype(np.uint16)
        wide = np.flatnonzero(data >= 0xC0)
        point[wide] = ((data[wide].astype(np.uint16) & 31) << 6) | (data[wide + 1] & 63)
        kind = self.table[point]
        kind[~lead] = kind[np.flatnonzero(~lead) - 1]
        new_row = np.zeros(n, bool)
        new_row[offsets[:-1][offsets[:-1] < n]] = True
        start = new_row.copy()
        start[1:] |= kind[1:] != kind[:-1]
        # Here each run of one class starts. The last space of a white-space run goes to what follows it, or stands alone.
        run = np.flatnonzero(start)
        ends = np.append(run[1:], n)
        blank = kind[run] == _S
        goes_on = np.append(~new_row[run[1:]], False)  # another run of the same row follows
        r = np.flatnonzero(blank & goes_on)
        last = ends[r] - 1
        while (back := ~lead[last]).any():
            last = last - back
        start[last] = True  # it leaves its own run
        joined = data[last] == 0x20
        start[ends[r][joined]] = False  # and takes the next run with it
        # Contractions: an apostrophe that starts a pre-token, with the next letters of a short list.
        quote = np.flatnonzero((data == 0x27) & start)
        for q in quote:
            stop = int(offsets[np.searchsorted(offsets, q, "right")])
            tail = data[q + 1 : min(q + 3, stop)].tobytes()
            k = 1 if tail[:1] in (b"s", b"t", b"m", b"d") else 2 if tail in (b"re", b"ve", b"ll") else 0
            if k:
                start[q + 1 : q + 1 + k] = False
                if q + 1 + k < stop and lead[q + 1 + k]:
                    start[q + 1 + k] = True
        return np.flatnonzero(start)

    def encode(self, chunk: Chunk) -> list[np.ndarray]:
        """Ids of each row of the chunk."""
        out: list[np.ndarray | None] = [None] * len(chunk)
        raw = chunk.data
        hard = set() if self.plain else set(range(len(chunk)))
        for at in np.flatnonzero(raw >= 0xD4) if self.plain else ():  # a lead byte of U+0500 and beyond
            hard.add(int(np.searchsorted(chunk.offsets, at, "right")) - 1)
        whole = raw.tobytes()
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                hard.add(int(np.searchsorted(chunk.offsets, at, "right")) - 1)
                at = whole.find(token, at + 1)

        def send(rows: list[int]) -> None:
            texts = [raw[chunk.offsets[r] : chunk.offsets[r + 1]].tobytes().decode() for r in rows]
            for r, e in zip(rows, self.library.encode_batch_fast(texts, add_special_tokens=False)):
                out[r] = np.array(e.ids, np.uint32)

        if hard:
            send(sorted(hard))
        easy = [r for r in range(len(chunk)) if r not in hard]
        if hard:
            keep = np.ones(len(raw), bool)
            for r in hard:
                keep[chunk.offsets[r] : chunk.offsets[r + 1]] = False
            data = raw[keep]
            sizes = np.diff(chunk.offsets)[easy]
            offsets = np.concatenate(([0], np.cumsum(sizes)))
        else:
            data, offsets = raw, chunk.offsets
        if not len(data):
            for r in easy:
                out[r] = np.zeros(0, np.uint32)
            return out
        start = self.pretokens(data, offsets)
        end = np.append(start[1:], len(data))
        p, q = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_RAW_BYTE[data] * p[: len(data)], out=sums[1:])
        h = mix((sums[end] - sums[start]) * q[start], 5)
        h[h == 0] = 1
        slot = self._find(h)
        new = np.flatnonzero(slot < 0)
        if len(new):
            unique, first = np.unique(h[new], return_index=True)
            if self.count + len(unique) > CACHE_ENTRIES:
                self.reset()
                new = np.arange(len(h))
                unique, first = np.unique(h, return_index=True)
            whole, first = data.tobytes(), new[first]
            self._learn(unique, [whole[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist())])
            slot[new] = self._find(h[new])
        size = self.size[slot]
        stops = np.cumsum(size, dtype=np.int64)
        ids = self.pool[np.repeat(self.begin[slot] - (stops - size), size) + np.arange(stops[-1])]
        cut = np.concatenate(([0], stops))[np.searchsorted(start, offsets)]
        for i, r in enumerate(easy):
            out[r] = ids[cut[i] : cut[i + 1]]
        long = np.flatnonzero(end - start > LONGEST)
        if len(long):
            send([easy[i] for i in np.unique(np.searchsorted(offsets, start[long], "right") - 1).tolist()])
        return out


_kept: dict[str, Tokeniser] = {}


def _made(path: str) -> Tokeniser:
    """A worker process's tokeniser, kept with its cache from task to task."""
    if path not in _kept:
        _kept[path] = Tokeniser(path)
    return _kept[path]


def pack(ranks: np.ndarray) -> bytes:
    """A block of ranks (uint32) in the format."""
    n = len(ranks)
    length = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = length - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    end = np.cumsum(length, dtype=np.int64)
    begin = end - length
    data = np.zeros(int(end[-1]) if n else 0, np.uint8)
    for k in range(4):
        has = length > k
        data[begin[has] + k] = (ranks[has] >> (8 * k)) & 0xFF
    return np.array([n, len(control), len(data), 0], "<u4").tobytes() + control.tobytes() + data.tobytes()


#: Data lengths of the four ids of each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpack(block: bytes) -> np.ndarray:
    """The ranks of a block."""
    n, controls, size, _ = np.frombuffer(block, "<u4", 4)
    control = np.frombuffer(block, np.uint8, controls, 16)
    data = np.frombuffer(block, np.uint8, size, 16 + int(controls))
    length = LENGTHS[control].reshape(-1)[: int(n)]
    begin = np.cumsum(length, dtype=np.int64) - length
    out = data[begin].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        has = np.flatnonzero(length > k)
        if not len(has):
            break
        out[has] |= data[begin[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def tokenise(docs: DataFrame, tokenizer: str, end_id: int, shards: int) -> DataFrame:
    """(shard, seq, doc_id, low, high, top): each whole text's ids and the end id as planes of their bytes (top is null
    where no id needs it), in ascending doc_id order by shard and seq. Null text: only the end id."""
    schema = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", pa.int64()), ("low", pa.binary()), ("high", pa.binary()), ("top", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made, seq = _made(tokenizer), 0
        tail = np.array([end_id], np.uint32)
        for batch in batches:
            shard, key, text = (batch.column(i) for i in range(3))
            for chunk in chunks(text):
                rows = [np.concatenate((ids, tail)).astype(np.uint32) for ids in made.encode(chunk)]
                low = [r.astype(np.uint8).tobytes() for r in rows]
                high = [(r >> 8).astype(np.uint8).tobytes() for r in rows]
                top = [(r >> 16).astype("<u2").tobytes() if r.max() > 0xFFFF else None for r in rows]
                part = [shard.slice(chunk.first, len(chunk)), pa.array(range(seq, seq + len(chunk)), pa.int64()), key.slice(chunk.first, len(chunk)), *(pa.array(x, pa.binary()) for x in (low, high, top))]
                seq += len(chunk)
                yield pa.RecordBatch.from_arrays(part, schema=schema)

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = plain.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    return ordered.mapInArrow(run, "shard int, seq long, doc_id long, low binary, high binary, top binary")


def _ids(low, high, top) -> np.ndarray:
    ids = np.frombuffer(low.as_buffer(), np.uint8).astype(np.uint32)
    ids |= np.frombuffer(high.as_buffer(), np.uint8).astype(np.uint32) << np.uint32(8)
    if top.is_valid:
        ids |= np.frombuffer(top.as_buffer(), "<u2").astype(np.uint32) << np.uint32(16)
    return ids


def frequencies(tokens: DataFrame) -> DataFrame:
    """(id, n) over all documents; a task adds up its own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                n = np.bincount(np.concatenate([_ids(*row) for row in zip(*part.columns)]))
                if len(n) > len(total):
                    total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
                total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return tokens.select("low", "high", "top").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_blocks(tokens: DataFrame, codebook: list[int]) -> DataFrame:
    """Blocks of consecutive documents of a shard, numbered by their first document's place in it.
    codebook: ids by rank; its length is bounded by the vocabulary."""
    rank_of = np.zeros(max(codebook, default=0) + 1, np.uint32)
    rank_of[codebook] = np.arange(len(codebook), dtype=np.uint32)
    schema = "shard int, block long, n_ids long, doc_ids array<long>, doc_sizes array<int>, payload binary"
    arrow = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_sizes", pa.list_(pa.int32())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        keys: list[int | None] = []
        at, filled = (0, 0), 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            row = [[at[0]], [at[1]], [len(ids)], [keys], [[len(x) for x in held]], [pack(rank_of[ids])]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, arrow)], schema=arrow)

        for batch in batches:
            shards, seqs, docs = (batch.column(i).to_pylist() for i in range(3))
            for shard, seq, doc, *planes in zip(shards, seqs, docs, *batch.columns[3:]):
                ids = _ids(*planes)
                if held and (shard != at[0] or seq != at[1] + len(held) or filled + len(ids) > BLOCK_IDS):
                    yield flush()
                    held, keys, filled = [], [], 0
                if not held:
                    at = (shard, seq)
                held.append(ids)
                keys.append(doc)
                filled += len(ids)
        if held:
            yield flush()

    return tokens.select("shard", "seq", "doc_id", "low", "high", "top").mapInArrow(run, schema)


def read_blocks(blocks: DataFrame, codebook: list[int], starts: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the blocks alone. Payloads are decoded where they are read;
    only the documents' numbers are joined with the blocks' starts."""
    id_of = np.array(codebook or [0], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, keys, sizes, payload in zip(*batch.columns):
                ids = id_of[unpack(payload.as_buffer().to_pybytes())]
                n = np.array(sizes.as_py(), np.int64)
                end = np.cumsum(n)
                crc = [zlib.crc32(ids[e - k : e].tobytes()) for e, k in zip(end.tolist(), n.tolist())]
                at = [pa.array([v.as_py()] * len(n), t) for v, t in ((shard, pa.int32()), (block, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*at, keys.values, pa.array(end - n), pa.array(n), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = blocks.select("shard", "block", "doc_ids", "doc_sizes", "payload").mapInArrow(run, "shard int, block long, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return found.join(starts.hint("merge"), ["shard", "block"]).select("doc_id", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def block_starts(blocks: DataFrame) -> DataFrame:
    """Number of ids before each block. Shard totals (as many as range partitions) are summed in order in one task;
    blocks within a shard, shard by shard."""
    shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shard.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("inner"))
    return inner.join(before.hint("merge"), "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("start"))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> dict:
    """Writes docs(doc_id, text) as token files; returns {"blocks": table, "codebook": ids by rank, "documents": what
    read_blocks() finds in the files, "path": their folder}.

    Null and empty texts have the end id only; repeated rows are written as often as they occur, ties of doc_id by a
    hash of their texts; a null doc_id comes first. A very long text is tokenised whole and is a block of its own where it
    exceeds one. An empty table gives no blocks. Other columns are not looked at. The files are the written result: they stay
    where path says, or in a folder of the session's that goes with it.
    Texts are dealt out in order once and tokenised once, into a written table that the count and the files read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = scratch.save(tokenise(docs, tokenizer, end_id, shards), "ids")
    counted = frequencies(tokens).orderBy(F.desc("n"), "id").collect()  # at most one row per vocabulary entry
    codebook = [int(r["id"]) for r in counted]
    out, made = path or scratch.base, write_blocks(tokens, codebook)
    made.write.option("compression", "zstd").parquet(f"{out}/files")
    blocks = spark.read.schema(made.schema).parquet(f"{out}/files")
    spark.createDataFrame([(i, t) for i, t in enumerate(codebook)], "rank int, id int").write.parquet(f"{out}/codebook")
    scratch.drop("ids")
    return {"blocks": blocks, "codebook": codebook, "documents": read_blocks(blocks, codebook, block_starts(blocks)), "path": out}


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files of documents hold, read back from them."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))["documents"]
