"""Alignment of the tokens that two tokenizers make of the same texts, by the bytes that they stand for.

Tokens of both sides tile the same bytes. In a batch each token's start finds the other side's token that covers it
(``pandas.merge_asof`` keyed by document, once from either side); the union of both directions is every pair that
overlaps. Pairs that end together cut a document into groups and are its links. How often the ids of two linked tokens
are linked in the corpus is counted exactly: documents keep their distinct id pairs packed in a written table, counts
of tasks are added up, the most frequent pairs are broadcast (a fixed number at most) and all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import written
from orrery.llm.packing import _unit_encoder, byte_symbols

SPACE = "▁"
#: A unit of text: what stands between spaces, or after a line's end, without other white space.
UNIT = re.compile(r"\n?\S+")
#: Bytes of text worked on at once (a longer text is worked on alone) and bytes of units of text that a worker keeps.
CHUNK_BYTES, CACHE_BYTES = 2 << 20, 96 << 20
#: Id pairs whose counts are broadcast at most (12 bytes each), and pairs that a task counts before it sends them on.
FREQUENT, COUNTED = 1 << 19, 1 << 20


class Aligner:
    """Token ids of both sides for lists of texts; texts that a side does not give back byte for byte have none."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        with open(byte_level, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"] for t in spec["added_tokens"]}
        symbol = byte_symbols()
        shown = {i: t.encode() if t in added else bytes(symbol[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        shown |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        self.bytes_a = [shown.get(i, b"") for i in range(max(shown) + 1)]
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.len_a, self.len_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        own = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # where a space or a line's end may be inside a piece, or the other side is of another kind, texts go whole
        safe = not any("\n" in p or (SPACE in p[1:] and p.strip(SPACE)) for p in own)
        self.units = _unit_encoder(byte_level) if safe else None
        self.alone = self.b.piece_to_id(SPACE)
        self._forget()

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace(SPACE, " ").encode()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.ids = (array("i"), array("i"))
        self.first = (array("q", [0]), array("q", [0]))

    def _add(self, a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Codes of new entries with these ids."""
        for ids, first, new in zip(self.ids, self.first, (a, b), strict=True):
            first.frombytes((len(ids) + np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))).tobytes())
            ids.extend(chain.from_iterable(new))
        return np.arange(len(self.first[0]) - 1 - len(a), len(self.first[0]) - 1)

    def _same(self, a: Iterable[int], b: Iterable[int], text: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == text and b"".join(map(self.bytes_b.__getitem__, b)) == text

    def _learn(self, units: list[str]) -> None:
        """Codes of units, -1 for those that are no unit or do not come back byte for byte."""
        self.known.update(dict.fromkeys(units, -1))
        self.size += sum(map(len, units)) + 180 * len(units)
        plain = [u for u in units if UNIT.fullmatch(u)]
        b = self.b.encode(plain, num_threads=1) if plain else []
        for k, u in enumerate(plain):
            if u[0] == "\n":
                b[k] = b[k][1:] if b[k][:1] == [self.alone] else []
        texts = [u if u[0] == "\n" else " " + u for u in plain]
        a = list(map(self.units, texts))
        if not self._same(chain.from_iterable(a), chain.from_iterable(b), "".join(texts).encode()):
            sound = [k for k, t in enumerate(texts) if self._same(a[k], b[k], t.encode())]
            plain, a, b = ([x[k] for k in sound] for x in (plain, a, b))
        self.known.update(zip(plain, self._add(a, b).tolist(), strict=True))

    def __call__(self, texts: list[str]) -> tuple[tuple[np.ndarray, ...], ...]:
        """(ids, text of each token) of either side.

        Neither side joins characters across a space or a line's end that stands between two others, so a text's ids
        are those of its units; a unit is encoded once. All other texts are encoded whole.
        """
        if self.size > CACHE_BYTES:
            self._forget()
        split = [t.replace("\n", " \n").split(" ") if t and self.units else [] for t in texts]
        self._learn(list(set().union(*split).difference(self.known)))
        n = np.fromiter(map(len, split), np.int64, len(texts))
        flat = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(n.sum()))
        owner = np.repeat(np.arange(len(texts)), n)
        odd = np.unique(owner[flat < 0]) if self.units else np.array([k for k, t in enumerate(texts) if t], np.int64)
        kept = [len(x) for x in self.ids], len(self.first[0])
        if len(odd):
            said = [texts[k] for k in odd]
            a = [e.ids for e in self.a.encode_batch([" " + t for t in said], add_special_tokens=False)]
            b = self.b.encode(said, num_threads=1)
            sound = [k for k, t in enumerate(said) if self._same(a[k], b[k], b" " + t.encode())]
            codes = self._add([a[k] for k in sound], [b[k] for k in sound])
            good = ~np.isin(owner, odd)
            flat, owner = np.concatenate([flat[good], codes]), np.concatenate([owner[good], odd[sound]])
            order = np.argsort(owner, kind="stable")
            flat, owner = flat[order], owner[order]
        sides = []
        for ids, first in zip(self.ids, self.first, strict=True):
            first = np.array(first, np.int64)
            n = first[flat + 1] - first[flat]
            place = np.repeat(first[flat] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            sides.append((np.array(ids, np.int64)[place], np.repeat(owner, n)))
        for ids, first, most in zip(self.ids, self.first, kept[0], strict=True):  # whole texts are not kept
            del ids[most:], first[kept[1] :]
        return tuple(sides)


def overlaps(start_a: np.ndarray, doc_a: np.ndarray, start_b: np.ndarray, doc_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all tokens that share bytes; starts are places in the batch, the same on both sides."""
    a = pd.DataFrame({"at": start_a, "doc": doc_a, "i": np.arange(len(start_a))})
    b = pd.DataFrame({"at": start_b, "doc": doc_b, "j": np.arange(len(start_b))})
    covering_b = pd.merge_asof(a, b, on="at", by="doc")["j"].to_numpy(np.int64)
    covering_a = pd.merge_asof(b, a, on="at", by="doc")["i"].to_numpy(np.int64)
    more = np.flatnonzero(start_b > start_a[covering_a])  # equal starts are in the first direction already
    return np.concatenate([np.arange(len(start_a)), covering_a[more]]), np.concatenate([covering_b, more])


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
#: Decimal ids with what may follow them, made once for a worker.
_SHOWN: dict[int, pa.Array] = {}


def _shown(ids: int) -> pa.Array:
    if ids not in _SHOWN:
        _SHOWN[ids] = pa.array([f"{i}{end}" for i in range(ids) for end in ",|;"])
    return _SHOWN[ids]


def _group_texts(ids_a, ids_b, last_a, last_b, tokens: np.ndarray, vocabulary: int) -> list[str]:
    """``a1,a2|b1;a3|b2`` of each text. last_a, last_b: whether a token ends a group; tokens: how many a text has."""
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=groups))])
    upto_a = np.cumsum(np.bincount(group_a, minlength=groups))
    entry = np.empty(len(ids_a) + len(ids_b), np.int64)
    entry[np.arange(len(ids_a)) + before_b[group_a]] = ids_a * 3 + last_a
    entry[np.arange(len(ids_b)) + upto_a[group_b]] = ids_b * 3 + 2 * last_b
    said = _shown(vocabulary).take(pa.array(entry))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tokens)]), pa.int32()), said), "")
    return [x[:-1] for x in joined.to_pylist()]


def _lists(of: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Lists of ``values``, which are in order of their rows ``of``."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _packed(of: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    at, data = np.searchsorted(of, np.arange(n + 1)) * values.itemsize, values.tobytes()
    return pa.array([data[at[k] : at[k + 1]] for k in range(n)], pa.binary())


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = size = 0
    for k, t in enumerate(texts):
        if k > at and size + len(t or "") > CHUNK_BYTES:
            yield at, k
            at, size = k, 0
        size += len(t or "")
    if len(texts) > at:
        yield at, len(texts)


def _align(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str, spans: bool) -> Iterator[pa.RecordBatch]:
    key = (byte_level, pieces)
    aligner = _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))
    vocabulary = max(len(aligner.len_a), len(aligner.len_b))
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for low, high in _chunks(texts):
            n = high - low
            (ids_a, doc_a), (ids_b, doc_b) = aligner([t or "" for t in texts[low:high]])
            end_a, end_b = np.cumsum(aligner.len_a[ids_a]), np.cumsum(aligner.len_b[ids_b])
            i, j = overlaps(end_a - aligner.len_a[ids_a], doc_a, end_b - aligner.len_b[ids_b], doc_b) if len(ids_a) else (doc_a, doc_b)
            link = end_a[i] == end_b[j]
            li, lj = i[link], j[link]
            last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
            last_a[li] = last_b[lj] = 1
            count = lambda d: np.bincount(d, minlength=n)
            said = _group_texts(ids_a, ids_b, last_a, last_b, count(doc_a) + count(doc_b), vocabulary)
            columns = [batch.column(c).slice(low, n) for c in (0, 1)]
            columns += [pa.array(x, pa.int64()) for x in (count(doc_a), count(doc_b), count(doc_a[last_a == 1]), count(doc_a[li]), count(doc_a[i]))]
            columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in said], pa.string()))
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
            pair = doc_a[li] * (len(aligner.len_a) * len(aligner.len_b)) + ids_a[li] * len(aligner.len_b) + ids_b[lj]
            pair, times = np.unique(pair, return_counts=True)
            of, pair = np.divmod(pair, len(aligner.len_a) * len(aligner.len_b))
            columns += [_packed(of, n, pair.astype("<u8" if len(aligner.len_a) * len(aligner.len_b) > 1 << 32 else "<u4")), _packed(of, n, times.astype("<u4"))]
            names += ["pairs", "times"]
            if spans:
                order = np.lexsort((j, i))
                base = np.concatenate([[0], np.cumsum(np.bincount(doc_a, aligner.len_a[ids_a], n))]).astype(np.int64)
                first = [np.searchsorted(d, np.arange(n)) for d in (doc_a, doc_b)]
                i, j = i[order], j[order]
                columns += [_lists(doc_a, n, ids_a, pa.int32()), _lists(doc_a, n, end_a - base[doc_a], pa.int64()), _lists(doc_b, n, ids_b, pa.int32()), _lists(doc_b, n, end_b - base[doc_b], pa.int64())]
                columns += [_lists(doc_a[i], n, i - first[0][doc_a[i]], pa.int32()), _lists(doc_a[i], n, j - first[1][doc_a[i]], pa.int32())]
                columns.append(pa.array(said, pa.string()))
                names += ["ids_a", "ends_a", "ids_b", "ends_b", "overlap_a", "overlap_b", "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def aligned(docs: DataFrame, byte_level: str, pieces: str, spans: bool = True) -> DataFrame:
    """One row for each document (doc_id, text) with both sides' tokens and how they meet.

    (row, doc_id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs, times) and with ``spans`` also ids_a,
    ends_a, ids_b, ends_b (ids and the byte where each token ends in the text with a space before it), overlap_a and
    overlap_b (numbers of the tokens of every pair that shares bytes) and groups (``a1,a2|b1;…``). ``pairs`` and
    ``times`` are a document's distinct linked id pairs (id of A times B's vocabulary plus id of B) and how often each
    is linked, packed little-endian. Null and empty texts, and those that a side does not give back byte for byte, have
    no tokens, zeros and ''. Repeated rows and ids are rows of their own; other columns are ignored. ``row`` differs
    for every row but is not the same when computed again: write the table before joining on it.
    """
    schema = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs binary, times binary"
    if spans:
        schema += ", ids_a array<int>, ends_a array<long>, ids_b array<int>, ends_b array<long>, overlap_a array<int>, overlap_b array<int>, groups string"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lambda x: _align(x, byte_level, pieces, spans), schema)


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column of packed numbers, and how many each row has."""
    n = np.array([len(x) for x in column.to_pylist()], np.int64) // np.dtype(kind).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.int64), n


def _counts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """Sums of a task's counts, sent on whenever it holds COUNTED pairs."""
    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def added(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([pair, *(w[0] for w in waiting)]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, where, np.concatenate([n, *(w[1] for w in waiting)]))
        waiting.clear()
        return keys, sums

    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            waiting.append((_unpacked(part.column(0), kind)[0], _unpacked(part.column(1), "<u4")[0]))
            if sum(len(w[0]) for w in waiting) > COUNTED:
                pair, n = added(pair, n)
                if len(pair) > COUNTED:
                    yield sent()
                    pair, n = pair[:0], n[:0]
    pair, n = added(pair, n)
    yield sent()


def scored(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Adds to each document's numbers how common its links are: n_best and count_sum.

    The count of an id pair is how many links of the corpus link these two ids. n_best: links whose count is the
    highest that their B id has with any A id, ties included; count_sum: the sum over links. Documents without tokens
    have zeros; an empty table gives none.
    """
    spark = docs.sparkSession
    found = written(aligned(docs, byte_level, pieces, spans=False), "aligned")
    import sentencepiece
    from tokenizers import Tokenizer

    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    size_a = Tokenizer.from_file(byte_level).get_vocab_size(True)
    kind = "<u8" if size_a * size_b > 1 << 32 else "<u4"
    counts = found.select("pairs", "times").mapInArrow(lambda x: _counts(x, kind), "pair long, n long")
    counts = written(counts.groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b_id = F.pmod(F.col("pair"), F.lit(size_b))
    best = np.zeros(size_b, np.int64)
    for b, n in counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("n")).collect():  # a row an id of the vocabulary at most
        best[b] = n
    # the lowest eighth of a power of two such that the pairs from there up are few enough to be broadcast
    step = F.floor(F.log2("n") * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    least, total = None, 0
    for s in steps:  # some hundreds at most
        total += s.k
        if total > FREQUENT:
            break
        least = s.least
    often = counts.where(F.col("n") >= least) if least is not None else counts.limit(0)
    table = often.select("pair", "n").toPandas().sort_values("pair")  # FREQUENT rows at most
    sent = spark.sparkContext.broadcast((table["pair"].to_numpy(np.int64), table["n"].to_numpy(np.int64), best))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers, best = sent.value
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                m = batch.num_rows
                (pair, per), (times, _) = _unpacked(batch.column("pairs"), kind), _unpacked(batch.column("times"), "<u4")
                of = np.repeat(np.arange(m), per)
                at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
                known = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
                n = numbers[at[known]]
                top = n == best[pair[known] % len(best)]
                sums = [np.zeros(m, np.int64), np.zeros(m, np.int64)]
                np.add.at(sums[0], of[known], times[known] * top)
                np.add.at(sums[1], of[known], times[known] * n)
                names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256"]
                columns = [batch.column(c) for c in names] + [pa.array(x) for x in sums]
                columns += [_lists(of[~known], m, pair[~known], pa.int64()), _lists(of[~known], m, times[~known], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "__best", "__sum", "rare", "rare_times"])

    own = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string"
    part = found.mapInArrow(add, f"{own}, __best long, __sum long, rare array<long>, rare_times array<long>")
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    rare = counts.where(F.col("n") < least) if least is not None else counts
    if least is not None and not rare.head(1):
        return part.select(*columns, F.col("__best").alias("n_best"), F.col("__sum").alias("count_sum"), "groups_sha256", "n_overlaps")
    part = written(part, "scored")
    tops = spark.createDataFrame(pd.DataFrame({"__b": np.arange(size_b), "__top": best}))
    rare = rare.join(F.broadcast(tops), b_id == F.col("__b")).select("pair", "n", (F.col("n") == F.col("__top")).alias("__is"))
    links = part.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("z")).select("row", F.col("z.rare").alias("pair"), F.col("z.rare_times").alias("times"))
    more = links.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("__is"), F.col("times")).otherwise(0)).alias("__more_best"), F.sum(F.col("times") * F.col("n")).alias("__more_sum"))
    both = part.drop("rare", "rare_times").join(more, "row", "left")
    sums = [(F.col(f"__{a}") + F.coalesce(F.col(f"__more_{a}"), F.lit(0))).alias(b) for a, b in (("best", "n_best"), ("sum", "count_sum"))]
    return both.select(*columns, *sums, "groups_sha256", "n_overlaps")


def op11(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``: byte-level tokens against pieces."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
