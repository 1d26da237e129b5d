"""Language-model scores by cross-entropy difference.

A target model, from documents labelled good, and a background model, from all documents, are bigram models of one
kind over one vocabulary, the words of all documents. A token's loss under a model mixes its pair probability with its
word probability; a document's score is the mean difference of its tokens' losses, target less background, so the
lowest scores read most like the target.

Counts are exact and grow with the input. The most frequent words are broadcast with their counts, and so are the
losses of the most frequent pairs; how many only decides which way a token goes, not its loss. Every other pair is
counted where its tokens meet: workers send, packed, the pairs of many documents at once to buckets of pairs, where
counts give losses, and a bucket sends each document's sum back. A token with one rare word meets the others of that
word, one with two is joined. Losses are whole numbers of 2^-20, so that sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import written
from orrery.llm.words import ALNUM, Words, buffers, chunks, mixed

#: Words (at most 2^20) and pairs that are broadcast at most.
HOT_WORDS, HOT_PAIRS = 1 << 19, 1 << 19
#: Ids of documents of the target that are broadcast at most; beyond, documents are joined to them and written.
GOOD_IDS = 1 << 22
#: Share of the pair probability in a token's probability, and what the count of each word is raised by.
PAIR_SHARE, SMOOTH = 0.6, 0.5
#: Steps of a loss.
UNIT = 1 << 20
#: What stands before the first token of a text.
START = 0
#: Tokens and rows that a worker packs at once, and how often a pair must be among them to be looked at as frequent: a
#: pair that is so frequent on average is so in one of the packs.
HELD, HELD_ROWS, OFTEN = 400_000, 50_000, 2
#: Rows that are read at once: with HELD_ROWS no more than 16 bits number.
READ_ROWS = (1 << 16) - 1 - HELD_ROWS
#: Tokens that meet in a bucket on average, and the bits of the least number of buckets.
MET, LEAST_BITS = 2_000_000, 8
#: Places of words and bits of a pair of them.
_PLACE = np.uint64(20)
_PAIR_BITS = 40
_SPREAD = 0x9E3779B97F4A7C15 % (1 << _PAIR_BITS) | 1
_BACK = pow(_SPREAD, -1, 1 << _PAIR_BITS)
_NEXT = np.uint64(0x9FB21C651E98DF25)
_FIRST = np.uint32((1 << 31) - 1)  # in place of a word before: the text begins


class Pack:
    """Tokens of some rows: of each token its row, the word before it and its word; tokens and flags of each row."""

    def __init__(self, parts: list[tuple], columns: list[tuple[pa.Array, ...]], ids: np.ndarray | None):
        n, row, before, word = ([p[i] for p in parts] for i in range(4))
        self.n = np.concatenate(n)
        begins = np.cumsum([0, *(len(x) for x in n[:-1])])
        self.row = np.concatenate([r + b for r, b in zip(row, begins, strict=True)])
        self.before, self.word = np.concatenate(before), np.concatenate(word)
        self.doc_id, self.key, good = (pa.concat_arrays(c) for c in zip(*columns, strict=True))
        self.good = good.to_numpy(zero_copy_only=False).astype(bool)
        if ids is not None and len(ids):
            doc = self.doc_id.fill_null(0).to_numpy()
            at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            self.good |= (ids[at] == doc) & self.doc_id.is_valid().to_numpy(zero_copy_only=False)


def _packs(batches: Iterator[pa.RecordBatch], sent=None) -> Iterator[Pack]:
    """``batches`` have text, doc_id, key and whether a row is of the target; ``sent`` has ids of more such rows."""
    ids = sent.value if sent else None
    parts, kept, tokens, rows = [], [], 0, 0
    for batch in batches:
        data, offsets = buffers(batch.column(0))
        for a, b in ((c, min(c + READ_ROWS, z)) for a, z in chunks(offsets) for c in range(a, z, READ_ROWS)):
            w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALNUM)
            h = w.hashes().view(np.int64)
            before = np.full(len(h), START, np.int64)
            after = w.doc[1:] == w.doc[:-1]
            before[1:][after] = h[:-1][after]
            parts.append((w.n, w.doc, before, h))
            kept.append(tuple(c.slice(a, b - a) for c in batch.columns[1:]))
            tokens, rows = tokens + len(h), rows + b - a
            if tokens > HELD or rows > HELD_ROWS:
                yield Pack(parts, kept, ids)
                parts, kept, tokens, rows = [], [], 0, 0
    if parts:
        yield Pack(parts, kept, ids)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of the values of each."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], *(np.add.reduceat(v[order], at) if len(at) else v[:0] for v in values)


def _count(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Counts of all words, and of the pairs that are often in a pack."""
    for p in _packs(batches, sent):
        one = np.ones(len(p.word), np.int64)
        word, n, good = _sums(p.word, one, p.good[p.row].astype(np.int64))
        pair = np.flatnonzero(p.before != START)
        key = mixed(p.before[pair].view(np.uint64) * _NEXT + p.word[pair].view(np.uint64))
        _, at, times = np.unique(key, return_index=True, return_counts=True)
        at, times = pair[at[times >= OFTEN]], times[times >= OFTEN]
        nothing = np.full(len(word), START, np.int64)
        columns = [np.concatenate(c) for c in ((nothing, p.before[at]), (word, p.word[at]), (good, np.zeros(len(at), np.int64)), (n, times))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["before", "word", "good", "n"])


def _count_pairs(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    for p in _packs(batches, sent):
        pair = p.before != START
        at, good = np.stack([p.before[pair], p.word[pair]], 1), p.good[p.row[pair]].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1]), pa.array(good), pa.array(np.ones(len(at), np.int64))], names=["before", "word", "good", "n"])


class Counts:
    """A table of counts: ``n`` over all documents, ``good`` over those of the target."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sum(self) -> int:
        return self.rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def frequent(self, most: int) -> int:
        """The least count from which on at most ``most`` rows have it."""
        step = F.ceil(F.log2("n") * 8)
        bins = self.rows.groupBy(step.alias("b")).agg(F.count("*").alias("c"), F.min("n").alias("n"), F.max("n").alias("top")).orderBy(F.desc("b")).collect()
        least, rows = bins[0].top + 1 if bins else 1, 0
        for r in bins:
            rows += r.c
            if rows > most:
                break
            least = r.n
        return least


_COUNTS = "before long, word long, good long, n long"


class Model:
    """Counts over ``docs`` (text, doc_id, k, good): ``words``, ``pairs``, and ``often``, the pairs that packs hold often."""

    def __init__(self, docs: DataFrame, ids=None):
        self.docs, self.ids = docs, ids
        counted = docs.mapInArrow(lambda x: _count(x, ids), _COUNTS)
        counted = written(counted.groupBy("before", "word").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "words")
        self.words = Counts(counted.where(F.col("before") == START).select("word", "good", "n"))
        self.often = Counts(counted.where(F.col("before") != START))
        pairs = docs.mapInArrow(lambda x: _count_pairs(x, ids), _COUNTS)
        self.pairs = Counts(pairs.groupBy("before", "word").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))  # run only if asked for


def fitted(docs: DataFrame, good: DataFrame | None = None) -> Model:
    """The model of all rows of ``docs`` (doc_id, text).

    The target are the rows whose doc_id is in ``good`` (doc_id), or those with ``good`` if there is such a column.
    ``docs`` should be a table: rows are read again and must come in the same order.
    """
    key = F.xxhash64("doc_id", "text").alias("k")
    if good is None:
        flag = F.coalesce("good", F.lit(False)) if "good" in docs.columns else F.lit(False)
        return Model(docs.select("text", "doc_id", key, flag.alias("good")))
    good = good.select("doc_id").na.drop().distinct()
    if good.count() > GOOD_IDS:
        flagged = docs.select("doc_id", "text").join(good.withColumn("good", F.lit(True)), "doc_id", "left")
        return Model(written(flagged.select("text", "doc_id", key, F.coalesce("good", F.lit(False)).alias("good")), "flagged"))
    ids = np.sort(good.toArrow().column(0).to_numpy())
    return Model(docs.select("text", "doc_id", key, F.lit(False).alias("good")), docs.sparkSession.sparkContext.broadcast(ids))


class Losses:
    """Losses of tokens from counts; the words that are broadcast, sorted, with their counts."""

    def __init__(self, size, words: list[np.ndarray]):
        self.total = {"good": size.good + SMOOTH * size.v, "n": size.n + SMOOTH * size.v}
        self.word, good, n = words
        self.count = {"good": good, "n": n}
        self.pairs, self.pair_loss = np.zeros(0, np.uint64), (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def places(self, words: np.ndarray) -> np.ndarray:
        """Of each word its place among those that are broadcast, or -1."""
        if not len(self.word):
            return np.full(len(words), -1, np.int64)
        at = np.minimum(np.searchsorted(self.word, words), len(self.word) - 1)
        return np.where(self.word[at] == words, at, -1)

    def of(self, which: str, pair: np.ndarray, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Losses, in steps, of tokens with these counts; nothing before them counts 0."""
        one = (word + SMOOTH) / self.total[which]
        two = pair / np.maximum(before, 1)
        loss = np.where(before > 0, PAIR_SHARE * two + (1 - PAIR_SHARE) * one, one)
        return np.rint(-np.log(loss) * UNIT).astype(np.int64)

    def both(self, pair: dict, before: dict, word: dict) -> tuple[np.ndarray, np.ndarray]:
        return tuple(self.of(k, pair[k], before[k], word[k]) for k in ("good", "n"))

    def known(self, at: np.ndarray) -> dict:
        return {k: c[at] for k, c in self.count.items()}


def _planes(x: np.ndarray) -> bytes:
    """The bytes of numbers, first bytes first: what is alike in them lies together."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _unplaned(data: memoryview, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width).reshape(width, n).T).view(kind).ravel()


def _times(key: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each is there; in several entries where that is more than ``most``."""
    key, n = np.unique(key, return_counts=True)
    return _entries(n, most, key)


def _entries(n: np.ndarray, most: int, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """``keys`` and ``n``, the rows of n over ``most`` as several, in the same order."""
    copies = -(-n // most)
    if len(n) and copies.max() > 1:
        keys = tuple(np.repeat(k, copies) for k in keys)
        turn = np.arange(int(copies.sum())) - np.repeat(np.cumsum(copies) - copies, copies)
        n = np.minimum(np.repeat(n, copies) - turn * most, most)
    return *keys, n


# --- packing: one row for each pack and bucket

_PACKED = "bucket int, part long, pack long, n array<int>, data binary"


def _send(batches: Iterator[pa.RecordBatch], ids, losses: Losses, bits: int) -> Iterator[pa.RecordBatch]:
    """Rows of each pack: its documents (bucket -1) and its entries for each bucket."""
    schema = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), ("pack", pa.int64()), ("n", pa.list_(pa.int32())), ("data", pa.binary())])
    for turn, p in enumerate(_packs(batches, ids)):
        pack = TaskContext.get().partitionId() << 32 | turn
        word = losses.places(p.word)
        begins = p.before == START
        before = np.full(len(word), -1, np.int64)
        before[1:] = word[:-1]
        before[begins] = -1
        known, flag = (word >= 0) & ((before >= 0) | begins), p.good.astype(np.uint8) << 7
        t, b = np.zeros(len(word)), np.zeros(len(word))
        at = np.flatnonzero(known & begins)
        if len(at):
            nothing = {"good": np.zeros(len(at)), "n": np.zeros(len(at))}
            t[at], b[at] = losses.both(nothing, nothing, losses.known(word[at]))
        at = np.flatnonzero(known & ~begins)
        key = before[at].astype(np.uint64) << _PLACE | word[at].astype(np.uint64)
        if len(losses.pairs):
            place = np.minimum(np.searchsorted(losses.pairs, key), len(losses.pairs) - 1)
            found = losses.pairs[place] == key
            t[at[found]], b[at[found]] = (x[place[found]] for x in losses.pair_loss)
            at, key = at[~found], key[~found]
        n = len(p.n)
        valid = p.doc_id.is_valid().to_numpy(zero_copy_only=False)
        home = [p.doc_id.fill_null(0).to_numpy(), valid.astype(np.int64), p.key.to_numpy(), p.n, *(np.bincount(p.row, x, n).astype(np.int64) for x in (t, b))]
        rows = [(-1, pack, pack, [n], b"".join(np.ascontiguousarray(c, np.int64).tobytes() for c in home))]

        # pairs of words that are broadcast: their places, spread over the buckets
        spread = key * np.uint64(_SPREAD) & np.uint64((1 << _PAIR_BITS) - 1)
        both, times = _times(spread << np.uint64(16) | p.row[at].astype(np.uint64), 127)
        spread, row = both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.uint16)
        low = np.uint64(_PAIR_BITS - bits)
        hot = (spread >> low, [(spread & ((np.uint64(1) << low) - np.uint64(1)), np.uint32), (row, np.uint16), (times.astype(np.uint8) | flag[row], np.uint8)])
        # one rare word: it meets its other tokens
        rare = np.flatnonzero(~known & ((word >= 0) | (before >= 0) | begins))
        is_word = word[rare] < 0
        other = np.where(is_word, np.where(begins[rare], _FIRST, before[rare]), word[rare])
        r = np.where(is_word, p.word[rare], p.before[rare]).view(np.uint64)
        aux, row = (other << 1 | ~is_word).astype(np.uint32), p.row[rare].astype(np.uint16)
        order = np.lexsort((row, aux, r))
        r, aux, row = r[order], aux[order], row[order]
        first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (aux[1:] != aux[:-1]) | (row[1:] != row[:-1])])) if len(r) else np.zeros(0, np.int64)
        r, aux, row, times = _entries(np.diff(np.append(first, len(r))), 127, r[first], aux[first], row[first])
        top = np.uint64(64 - bits)
        one = (r >> top, [(r, np.uint64), (aux, np.uint32), (row, np.uint16), (times.astype(np.uint8) | flag[row], np.uint8)])
        at = np.flatnonzero(word < 0)
        r, times, good = _sums(p.word[at].view(np.uint64), np.ones(len(at), np.uint32), p.good[p.row[at]].astype(np.uint32))
        counts = (r >> top, [(r, np.uint64), (times.astype(np.uint32), np.uint32), (good.astype(np.uint32), np.uint32)])

        edges = [np.searchsorted(kind[0], np.arange((1 << bits) + 1, dtype=np.uint64)).tolist() for kind in (hot, one, counts)]
        for bucket in range(1 << bits):
            spans = [(e[bucket], e[bucket + 1]) for e in edges]
            if any(a < z for a, z in spans):
                data = []
                for (a, z), (_, columns) in zip(spans, (hot, one, counts), strict=True):
                    for i, (c, kind) in enumerate(columns):
                        part = c[a:z]
                        data.append(_planes((np.diff(part, prepend=part[:1] * 0) if i == 0 else part).astype(kind)))
                rows.append((bucket, 0, pack, [z - a for a, z in spans], b"".join(data)))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_HOT = (np.uint32, np.uint16, np.uint8)
_ONE = (np.uint64, np.uint32, np.uint16, np.uint8)
_RARE = (np.uint64, np.uint32, np.uint32)
_SUMS = "pack long, n int, width int, data binary"


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each row by equal keys, and a row of each group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group, order[new]


def _meet(key, table: pa.Table, losses: Losses, bits: int) -> pa.Table:
    """Sums of losses by document of each pack, from all entries of a bucket."""
    bucket, packs = key[0].as_py(), table.column("pack").to_pylist()
    sizes, data = table.column("n").to_pylist(), [x.as_buffer() for x in table.column("data").combine_chunks()]
    if bucket < 0:
        return pa.table({"pack": pa.array(packs, pa.int64()), "n": pa.array([n for (n,) in sizes], pa.int32()), "width": pa.array([0] * len(packs), pa.int32()), "data": table.column("data")})
    columns: list[list[list[np.ndarray]]] = [[[] for _ in kinds] for kinds in (_HOT, _ONE, _RARE)]
    for ns, blob in zip(sizes, data, strict=True):
        at, view = 0, memoryview(blob)
        for n, kinds, into in zip(ns, (_HOT, _ONE, _RARE), columns, strict=True):
            for i, kind in enumerate(kinds):
                x = _unplaned(view[at:], n, kind)
                into[i].append(np.cumsum(x, dtype=kind) if i == 0 else x)
                at += n * np.dtype(kind).itemsize
    (rest, row, times), (r, aux, row1, times1), (word, n, good) = ([np.concatenate(c) for c in into] for into in columns)

    def counted(group: np.ndarray, times: np.ndarray, groups: int) -> dict:
        n = (times & 127).astype(float)
        return {"good": np.bincount(group, n * (times >> 7), groups), "n": np.bincount(group, n, groups)}

    spread = rest.astype(np.uint64) | np.uint64(bucket) << np.uint64(_PAIR_BITS - bits)
    group, at = _grouped(spread)
    pair = spread[at] * np.uint64(_BACK) & np.uint64((1 << _PAIR_BITS) - 1)
    before, after = (pair >> _PLACE).astype(np.int64), (pair & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    found = losses.both(counted(group, times, len(at)), losses.known(before), losses.known(after)) if len(at) else None
    word, n, good = _sums(word, n.astype(np.int64), good.astype(np.int64))
    group1, at = _grouped(r, aux)
    found1 = None
    if len(at):
        pairs = counted(group1, times1, len(at))
        place = np.searchsorted(word, r[at])
        own = {"good": good[place], "n": n[place]}
        is_word, other = aux[at] & 1 == 0, aux[at] >> 1
        begins = other == _FIRST
        there = losses.known(np.where(begins, 0, other)) if len(losses.word) else {k: np.zeros(len(at), np.int64) for k in own}
        there = {k: np.where(begins, 0, c) for k, c in there.items()}
        found1 = losses.both(pairs, {k: np.where(is_word, there[k], own[k]) for k in own}, {k: np.where(is_word, own[k], there[k]) for k in own})
    out: list[tuple] = []
    a = b = 0
    for pack, (n0, n1, _) in zip(packs, sizes, strict=True):
        rows = np.concatenate([row[a : a + n0], row1[b : b + n1]])
        many = np.concatenate([times[a : a + n0], times1[b : b + n1]]) & 127
        loss = [np.concatenate([*([x[group[a : a + n0]]] if n0 else []), *([y[group1[b : b + n1]]] if n1 else [])]) for x, y in zip(found or (None, None), found1 or (None, None), strict=True)] if len(rows) else []
        a, b = a + n0, b + n1
        if len(rows):
            docs, at = np.unique(rows, return_inverse=True)
            sums = [np.bincount(at, many * x).astype(np.uint64) for x in loss]
            kind = np.uint32 if max(int(s.max()) for s in sums) < 1 << 32 else np.uint64
            out.append((pack, len(docs), np.dtype(kind).itemsize, _planes(docs) + b"".join(_planes(s.astype(kind)) for s in sums)))
    names, kinds = ("pack", "n", "width", "data"), (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.table({k: pa.array([x[i] for x in out], kind) for i, (k, kind) in enumerate(zip(names, kinds, strict=True))})


def _back(table: pa.Table) -> pa.Table:
    """The documents of a pack with the sums that buckets have sent."""
    rows = list(zip(*(table.column(c).to_pylist() for c in ("n", "width", "data")), strict=True))
    n, _, data = next(x for x in rows if x[1] == 0)
    doc_id, valid, key, tokens, t, b = np.frombuffer(data, np.int64).reshape(6, n).copy()
    for m, width, data in rows:
        if width:
            view = memoryview(data)
            docs, kind = _unplaned(view, m, np.uint16), np.uint32 if width == 4 else np.uint64
            t[docs] += _unplaned(view[2 * m :], m, kind).astype(np.int64)
            b[docs] += _unplaned(view[(2 + width) * m :], m, kind).astype(np.int64)
    return pa.table({"doc_id": pa.array(doc_id, mask=valid == 0), "k": key, "n_tokens": tokens, "t": t, "b": b})


# --- frequent pairs, and tokens of two rare words


def _losses(model: Model) -> Losses:
    """The frequent words with their counts, and the frequent pairs of such words with their losses."""
    spark = model.docs.sparkSession
    words = model.words.rows
    size = words.agg(F.count("*").alias("v"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    hot = words.where(F.col("n") >= model.words.frequent(HOT_WORDS)).toArrow().sort_by("word")  # at most HOT_WORDS rows
    losses = Losses(size, [hot.column(c).to_numpy() for c in ("word", "good", "n")])
    often = model.often.rows.where(F.col("n") >= model.often.frequent(HOT_PAIRS)).select("before", "word").toArrow()  # at most HOT_PAIRS rows
    before, word = (losses.places(often.column(c).to_numpy()) for c in ("before", "word"))
    known = (before >= 0) & (word >= 0)
    losses.pairs = np.sort(before[known].astype(np.uint64) << _PLACE | word[known].astype(np.uint64))
    if len(losses.pairs):
        sent, ids = spark.sparkContext.broadcast(losses), model.ids
        rows = model.docs.mapInArrow(lambda x: _frequent(x, ids, sent.value), "place int, good long, n long")
        exact = rows.groupBy("place").agg(F.sum("good").alias("good"), F.sum("n").alias("n")).toArrow().sort_by("place")
        at = losses.pairs[exact.column("place").to_numpy()]
        pair = {k: exact.column(k).to_numpy() for k in ("good", "n")}
        losses.pair_loss = losses.both(pair, losses.known((at >> _PLACE).astype(np.int64)), losses.known((at & np.uint64((1 << 20) - 1)).astype(np.int64)))
    return losses


def _frequent(batches: Iterator[pa.RecordBatch], ids, losses: Losses) -> Iterator[pa.RecordBatch]:
    n, good = (np.zeros(len(losses.pairs), np.int64) for _ in range(2))
    for p in _packs(batches, ids):
        word = losses.places(p.word)
        before = np.full(len(word), -1, np.int64)
        before[1:] = word[:-1]
        at = np.flatnonzero((word >= 0) & (before >= 0) & (p.before != START))
        key = before[at].astype(np.uint64) << _PLACE | word[at].astype(np.uint64)
        place = np.minimum(np.searchsorted(losses.pairs, key), len(losses.pairs) - 1)
        found = losses.pairs[place] == key
        n += np.bincount(place[found], minlength=len(n))
        good += np.bincount(place[found & p.good[p.row[at]]], minlength=len(n))
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(good[at]), pa.array(n[at])], names=["place", "good", "n"])


def _twice_rare(batches: Iterator[pa.RecordBatch], ids, losses: Losses) -> Iterator[pa.RecordBatch]:
    for p in _packs(batches, ids):
        rare = losses.places(p.word) < 0
        at = np.flatnonzero(rare[1:] & rare[:-1] & (p.before[1:] != START)) + 1
        row, before, word = p.row[at], p.before[at], p.word[at]
        group, first = _grouped(row, before, word)
        columns = [p.key.to_numpy()[row[first]], before[first], word[first], np.bincount(group, minlength=len(first)), p.good[row[first]].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k", "before", "word", "n", "good"])


def _rare_sums(model: Model, losses: Losses, sent) -> DataFrame:
    """k and the sums of losses of its tokens of two rare words."""
    ids = model.ids
    tokens = model.docs.mapInArrow(lambda x: _twice_rare(x, ids, sent.value), "k long, before long, word long, n long, good long")
    tokens = written(tokens.groupBy("k", "before", "word").agg(F.max("n").alias("n"), F.max("good").alias("good"), F.count("*").alias("rows")), "rare")
    pairs = tokens.groupBy("before", "word").agg(F.sum(F.col("n") * F.col("rows")).alias("n"), F.sum(F.col("n") * F.col("rows") * F.col("good")).alias("good"))
    counts = lambda key, p: model.words.rows.select(F.col("word").alias(key), F.col("good").alias(f"{p}_good"), F.col("n").alias(f"{p}_n"))
    pairs = pairs.join(counts("word", "w"), "word").join(counts("before", "b"), "before")

    def loss(c: str) -> Column:
        one = (F.col(f"w_{c}") + SMOOTH) / F.lit(losses.total[c])
        mixed_ = F.when(F.col(f"b_{c}") > 0, PAIR_SHARE * (F.col(c) / F.col(f"b_{c}")) + (1 - PAIR_SHARE) * one).otherwise(one)
        return F.rint(-F.log(mixed_) * UNIT).cast("long")

    found = tokens.select("k", "before", "word", "n").join(pairs.select("before", "word", loss("good").alias("t"), loss("n").alias("b")), ["before", "word"])
    return found.groupBy("k").agg(F.sum(F.col("n") * F.col("t")).alias("rare_t"), F.sum(F.col("n") * F.col("b")).alias("rare_b"))


def score(model: Model) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for each row that ``model`` was fitted on.

    Losses are natural logarithms, means over the tokens; score is their difference. Null texts and texts without
    words have no tokens and null losses and score. Repeated rows count each and come back each; null ids come back
    and are no targets; extra columns are ignored; an empty table gives none.
    """
    spark, ids = model.docs.sparkSession, model.ids
    losses = _losses(model)
    sent = spark.sparkContext.broadcast(losses)
    bits = max(LEAST_BITS, int(np.ceil(np.log2(max(model.words.sum() / MET, 1)))))
    packed = model.docs.mapInArrow(lambda x: _send(x, ids, sent.value, bits), _PACKED)
    sums = packed.groupBy("bucket", "part").applyInArrow(lambda key, table: _meet(key, table, sent.value, bits), _SUMS)
    rows = sums.groupBy("pack").applyInArrow(_back, "doc_id long, k long, n_tokens long, t long, b long")
    rows = rows.join(_rare_sums(model, losses, sent), "k", "left")

    def mean(c: str) -> Column:
        return F.when(F.col("n_tokens") > 0, (F.col(c) + F.coalesce(f"rare_{c}", F.lit(0))) / (F.col("n_tokens") * UNIT))

    out = rows.select("doc_id", "n_tokens", mean("t").alias("target_loss"), mean("b").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op7(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``; the target are all documents that ``labels`` calls good."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")))


#: DuckDB's answer to the same question.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT r, good, CASE WHEN i > 1 THEN w[i - 1] END AS b, w[i] AS w FROM (SELECT r, coalesce(good, false) AS good, w, unnest(range(1, len(w) + 1)) AS i FROM d)
), u AS (SELECT w, count(*) AS n, count(*) FILTER (good) AS g FROM t GROUP BY w),
p AS (SELECT b, w, count(*) AS n, count(*) FILTER (good) AS g FROM t WHERE b IS NOT NULL GROUP BY b, w),
s AS (SELECT count(*) AS v, sum(n) AS n, sum(g) AS g FROM u),
c AS (
  SELECT t.r, (u.g + 0.5::DOUBLE) / (s.g + 0.5::DOUBLE * s.v) AS g1, (u.n + 0.5::DOUBLE) / (s.n + 0.5::DOUBLE * s.v) AS n1,
         coalesce(x.g, 0) AS bg, coalesce(x.n, 0) AS bn, coalesce(p.g, 0) AS pg, coalesce(p.n, 0) AS pn
  FROM t JOIN u ON u.w = t.w LEFT JOIN u x ON x.w = t.b LEFT JOIN p ON p.b = t.b AND p.w = t.w, s
), l AS (
  SELECT r, CAST(round(-ln(CASE WHEN bg > 0 THEN 0.6::DOUBLE * (pg / bg::DOUBLE) + (1 - 0.6::DOUBLE) * g1 ELSE g1 END) * 1048576) AS BIGINT) AS t,
         CAST(round(-ln(CASE WHEN bn > 0 THEN 0.6::DOUBLE * (pn / bn::DOUBLE) + (1 - 0.6::DOUBLE) * n1 ELSE n1 END) * 1048576) AS BIGINT) AS b FROM c
), m AS (SELECT r, count(*) AS n, CAST(sum(t) AS BIGINT) AS t, CAST(sum(b) AS BIGINT) AS b FROM l GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, t::DOUBLE / (n * 1048576) AS target_loss, b::DOUBLE / (n * 1048576) AS background_loss,
       t::DOUBLE / (n * 1048576) - b::DOUBLE / (n * 1048576) AS score
FROM d LEFT JOIN m USING (r)
"""
