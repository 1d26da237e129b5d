"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of benchmark items, the alphabet is words (as 64-bit hashes), a block is two
consecutive words. For each pattern length there is one shift table, indexed by block hash: how far the end of a
window may move without passing an occurrence. Where the shift is 0, the bucket of the block as a suffix gives the
patterns to compare, first all word hashes, then the words themselves.

Tables of a block of the benchmark take at most TABLE_BYTES for each byte of its text, so a block's broadcast is bounded;
a larger benchmark is searched block by block, and only hits of the later blocks are written and joined.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import union_rows, written
from orrery.llm.words import ALNUM, Words, buffers, chunks, mixed

#: Bytes of benchmark text whose tables are broadcast at once; a larger benchmark is searched in blocks of about this size.
BLOCK_BYTES = 4 << 20
#: Bytes that the tables take for a byte of text at most (words of one byte and a separator each, windows of all kinds).
TABLE_BYTES = 64
#: Window ends that one walker scans; walkers of a batch move together.
STRIDE = 64
_PAIR = np.uint64(0xD6E8FEB86659FD93)

ADDED = T.StructType([
    T.StructField("__n_words", T.LongType()),
    T.StructField("__spans", T.ArrayType(T.LongType())),
    T.StructField("__items", T.ArrayType(T.StringType())),
])


class Patterns:
    """Shift table and suffix buckets of the patterns of one length.

    ``text`` and ``starts``, ``ends`` are the words of all items, ``word`` their hashes; ``first`` the first word of each
    distinct pattern; the items of pattern p are ``items[bounds[p] : bounds[p + 1]]``.
    """

    def __init__(self, words: Words, first: np.ndarray, item: np.ndarray, length: int):
        self.length, self.block = length, min(2, length)
        self.text, self.starts, self.ends, self.word = words.data, words.starts.astype(np.uint32), words.ends.astype(np.uint32), words.hashes()
        rows = self.word[first[:, None] + np.arange(length)]
        key = rows[:, 0]
        for k in range(1, length):
            key = mixed(key * _PAIR + rows[:, k])
        order = np.lexsort((item, key))
        new = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]))
        self.bounds, self.items, self.first = np.append(new, len(order)).astype(np.uint32), item[order].astype(np.uint32), first[order[new]].astype(np.uint32)
        hashes = self.word[self.first[:, None] + np.arange(length)]
        size = 1 << max(12, int(np.ceil(np.log2(8 * max(1, len(self.first))))))
        self.mask = np.uint64(size - 1)
        self.shift = np.full(size, length - self.block + 1, np.uint8)
        for end in range(self.block - 1, length):  # later ends give smaller shifts
            at = (self._block(hashes, end) & self.mask).astype(np.int64)
            np.minimum.at(self.shift, at, np.uint8(length - 1 - end))
        suffix = self._block(hashes, length - 1)
        self.order = np.argsort(suffix, kind="stable").astype(np.uint32)
        self.suffix = suffix[self.order]

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _block(self, rows: np.ndarray, end: int) -> np.ndarray:
        return rows[:, end] if self.block == 1 else mixed(rows[:, end - 1] * _PAIR + rows[:, end])

    def _blocks(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return h[at] if self.block == 1 else mixed(h[at - 1] * _PAIR + h[at])

    def find(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of each occurrence."""
        ends = np.maximum(w.n - self.length + 1, 0)  # window ends by document
        walkers = -(-ends // STRIDE)
        doc = np.repeat(np.arange(len(ends)), walkers)
        turn = np.arange(len(doc)) - np.repeat(np.cumsum(walkers) - walkers, walkers)
        at = w.first[doc] + self.length - 1 + turn * STRIDE
        stop = np.minimum(at + STRIDE, w.first[doc + 1])
        found = []
        while len(at):
            shift = self.shift[(self._blocks(h, at) & self.mask).astype(np.int64)].astype(np.int64)
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        suffix = self._blocks(h, at)
        low, high = np.searchsorted(self.suffix, suffix, "left"), np.searchsorted(self.suffix, suffix, "right")
        n = high - low
        pattern = self.order[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] if n.sum() else np.zeros(0, np.int64)
        begin = np.repeat(at, n) - self.length + 1
        for k in range(self.length):
            same = h[begin + k] == self.word[self.first[pattern] + k]
            begin, pattern = begin[same], pattern[same]
        for b, p, f in zip(begin.tolist(), pattern.tolist(), self.first[pattern].tolist(), strict=True):
            if all(w.word(b + k) == self.text[self.starts[f + k] : self.ends[f + k]].tobytes() for k in range(self.length)):
                yield b, p


def patterns(items: list[tuple[str, str]], window: int) -> tuple[list[Patterns], list[str]]:
    """Tables of all windows of (item_id, text), and the ids; an item of fewer words than ``window`` is one window."""
    if not 1 <= window <= 255:
        raise ValueError("a window has 1 to 255 words")
    ids = sorted({i for i, _ in items})
    place = {i: k for k, i in enumerate(ids)}
    texts = [t.encode() for _, t in items]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
    w = Words(np.frombuffer(b"".join(texts), np.uint8), offsets, ALNUM)
    item = np.array([place[i] for i, _ in items], np.int64)
    lengths, tables = np.minimum(w.n, window), []
    for length in np.unique(lengths[lengths > 0]).tolist():
        of = np.flatnonzero(lengths == length)
        windows = w.n[of] - length + 1
        turn = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        tables.append(Patterns(w, np.repeat(w.first[of], windows) + turn, np.repeat(item[of], windows), length))
    return tables, ids


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for b, e in sorted(spans):
        if flat and b <= flat[-1]:
            flat[-1] = max(flat[-1], e)
        else:
            flat += [b, e]
    return flat


def _search(texts: pa.Array, built: tuple[list[Patterns], list[str]]) -> tuple[list[int], dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
    data, offsets = buffers(texts)
    tables, ids = built
    counts: list[int] = []
    spans, items = defaultdict(list), defaultdict(set)
    for a, b in chunks(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
        h = w.hashes()
        for t in tables:
            for begin, p in t.find(w, h):
                row = int(w.doc[begin])
                spans[a + row].append((begin - int(w.first[row]), begin - int(w.first[row]) + t.length))
                items[a + row].update(ids[i] for i in t.items[t.bounds[p] : t.bounds[p + 1]])
        counts += w.n.tolist()
    return counts, spans, items


def _sent(known: DataFrame, window: int, blocks: int, i: int):
    """The broadcast tables of one block of the benchmark (item, text)."""
    block = known.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i) if blocks > 1 else known
    return known.sparkSession.sparkContext.broadcast(patterns([(r.item, r.text) for r in block.collect()], window))


def _hits(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Of (k, text) the rows with hits, as k, spans and items."""
    for batch in batches:
        _, spans, items = _search(batch.column(1), sent.value)
        rows = sorted(spans)
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array([_merged(spans[r]) for r in rows], pa.list_(pa.int64())), pa.array([sorted(items[r]) for r in rows], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "spans", "items"])


def search(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with what of its ``text`` occurs in the items of ``benchmark`` (item_id, text).

    Adds __n_words (words of the text), __spans (flat begin, end pairs of hit words, merged, ends exclusive) and
    __items (sorted ids, as strings, of the items with an occurring window); columns of these names in ``docs`` are
    replaced, every other column passes through. Null or empty texts have no words and no hits. Items with null id or
    text, or without words, have no windows; rows of one id count as one item. An empty benchmark hits nothing;
    repeated rows of docs stay repeated. Items are spread over blocks by hash, an item is never cut.
    """
    known = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").na.drop()
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = docs.drop(*ADDED.names)
    columns = out.columns
    plain = out.toDF(*[f"c{i}" for i in range(len(columns))])  # any name of a column will do
    schema = T.StructType(plain.schema.fields + ADDED.fields)
    sent = _sent(known, window, blocks, 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, items = _search(batch.column(columns.index("text")), sent.value)
            rows = range(batch.num_rows)
            added = [
                pa.array(counts, pa.int64()),
                pa.array([_merged(spans[r]) if r in spans else [] for r in rows], pa.list_(pa.int64())),
                pa.array([sorted(items[r]) if r in items else [] for r in rows], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    found = plain.mapInArrow(scan, schema).toDF(*columns, *ADDED.names)
    if blocks == 1:
        return found
    # rows of equal text have equal hits: a later block's are found by a key of the text and joined
    key = F.sha2("text", 256)
    later = [docs.select(key.alias("k"), "text").mapInArrow(lambda x, s=_sent(known, window, blocks, i): _hits(x, s), "k string, spans array<bigint>, items array<string>").distinct() for i in range(1, blocks)]
    later = written(union_rows(later), "hits").groupBy("k").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    both = found.withColumn("__k", key).join(later.select(F.col("k").alias("__k"), F.col("spans").alias("__more"), F.col("items").alias("__others")), "__k", "left")
    nothing = [F.array().cast("array<bigint>"), F.array().cast("array<string>")]
    pairs = F.concat("__spans", F.coalesce("__more", nothing[0]))
    items = F.array_sort(F.array_distinct(F.concat("__items", F.coalesce("__others", nothing[1]))))
    return both.select(*[both[f"`{c}`"] for c in columns], "__n_words", _union(pairs).alias("__spans"), items.alias("__items"))


def _union(flat: Column) -> Column:
    """Flat begin, end pairs, merged where they meet."""
    pairs = F.array_sort(F.transform(F.sequence(F.lit(0), F.shiftright(F.size(flat), 1) - 1), lambda i: F.struct(F.get(flat, 2 * i).alias("b"), F.get(flat, 2 * i + 1).alias("e"))))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("bigint").alias("b"), F.lit(-1).cast("bigint").alias("e"))

    def step(a, x):
        meets = x["b"] <= a["e"]
        done = F.when(meets | (a["e"] < 0), a["done"]).otherwise(F.concat(a["done"], F.array(a["b"], a["e"])))
        return F.struct(done.alias("done"), F.when(meets, a["b"]).otherwise(x["b"]).alias("b"), F.when(meets, F.greatest(a["e"], x["e"])).otherwise(x["e"]).alias("e"))

    merged = F.aggregate(pairs, start, step, lambda a: F.concat(a["done"], F.array(a["b"], a["e"])))
    return F.when(F.size(flat) == 0, F.array().cast("array<bigint>")).otherwise(merged)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of what ``search`` returns."""
    hit = F.aggregate("__spans", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["s"] + a["sign"] * x).alias("s"), (-a["sign"]).alias("sign")))["s"]
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` against every item of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


#: DuckDB's answer to the same question, by joining every window with every window.
SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT l FROM p),
g AS (
  SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)
), m AS (SELECT g.doc_id, g.i, g.l, p.item_id FROM g JOIN p USING (l, g)),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS word FROM m) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
