"""Packing of tokenised documents into sequences, by a configuration linear program over the length histogram.

A configuration is a multiset of piece lengths that fits a sequence. The program covers the histogram with as few
configurations as it can. Multiplicative weights on the lengths play against a knapsack dynamic program that prices
configurations: each turn covers the demand with configurations of nearly the best price, and lengths that stay
uncovered or sit in wasteful configurations gain weight for the next turn. Any weights also give a lower bound by
duality. The solutions are rounded to whole configurations, what a rounding leaves over is placed by best fit, and the
best rounding is taken. Everything up to here works on the histogram (one number for each length up to the capacity),
whatever the number of documents; Spark then gives each piece a rank within its length and the plan maps ranks to
places.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import salted_rank, written

CAPACITY, SEPARATOR = 2048, 0
#: Turns of the multiplicative weights from each start (prices are lengths to the power 1 + start), prices of a turn at
#: most, and the step of the weights' logarithms.
STARTS, TURNS, PRICINGS, ETA = (0.0, 0.2), 4, 120, 0.1
#: How far below the best price, relatively, a configuration may be: from the first, doubled when little is covered.
NEAR, LAST = 0.001, 0.5
#: Share of the pieces that a rounding may leave to best fit for the turns to end at the bound.
LEFT = 0.02
#: Bytes that the units a worker remembers may take (texts, ids and UNIT_BYTES for each), the longest unit that is
#: remembered, and rows that are encoded at once.
CACHE_BYTES, UNIT_BYTES, LONGEST_UNIT, ROWS_AT_ONCE = 160 << 20, 250, 100, 256
#: Fixed value: how byte-level tokenizers split texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The byte that each character of a byte-level file stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _unit_encoder(tokenizer: str):
    """A quicker encoder of short texts with the same file's vocabulary and splitting, if the file is of that kind."""
    import tiktoken

    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    vocab, special = model["vocab"], {t["content"] for t in spec["added_tokens"]}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
    byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec["normalizer"]
    in_order = all(vocab.get(m) == 256 + k for k, m in enumerate(merges))
    if model.get("type", "BPE") not in ("BPE", None) or not (byte_level and in_order) or model.get("ignore_merges") or sys.byteorder != "little":
        return None
    byte = byte_symbols()
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


class Encoder:
    """Token ids of texts as bytes (little-endian, unsigned, 32 bits)."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes | None] = {}
        self.size = 0
        self.units = _unit_encoder(tokenizer)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text.

        A byte-level tokenizer starts a new part at a space between two other characters, so a text's ids are those
        of its units, each with the space before it; a unit is encoded once. Texts with other white space next to a
        space, or with special tokens, are encoded whole.
        """
        if self.size > CACHE_BYTES:
            self.known.clear()
            self.size = 0
        split = [t.split(" ") if t[:1].strip() else None for t in texts]
        new = list(set().union(*(u[1:] for u in split if u)).difference(self.known))
        long = [u for u in new if len(u) > LONGEST_UNIT]
        plain = [u for u in new if u and u == u.strip() and not any(s in u for s in self.special)]
        self.known.update(dict.fromkeys(new))
        if self.units:
            self.known.update((u, array("I", self.units(" " + u)).tobytes()) for u in plain)
        else:
            self.known.update(zip(plain, self._encode([" " + u for u in plain]), strict=True))
        self.size += sum(UNIT_BYTES + 4 * len(u) for u in new if len(u) <= LONGEST_UNIT)
        for t, u in zip(texts, split, strict=True):
            parts = [self.known[x] for x in u[1:]] if u else [None]
            if None in parts or u[0] != u[0].strip() or any(s in u[0] for s in self.special):
                yield self._encode([t])[0]
            else:
                yield self._encode([u[0]])[0] + b"".join(parts)
        for u in long:
            del self.known[u]


_ENCODERS: dict[str, Encoder] = {}


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int, ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, Encoder(tokenizer))
    end = np.array([SEPARATOR], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(1)
        rows, piece, start, length, crc, tokens = [], [], [], [], [], []
        parts = (encoder([t or "" for t in texts.slice(a, ROWS_AT_ONCE).to_pylist()]) for a in range(0, len(texts), ROWS_AT_ONCE))
        for i, encoded in enumerate(chain.from_iterable(parts)):
            whole = encoded + end
            n = len(whole) // 4
            first = n if n <= capacity else n % capacity or capacity
            at = 0
            for k in range(1 + (n - first) // capacity):
                to = first + k * capacity
                part = whole[4 * at : 4 * to]
                rows.append(i), piece.append(k), start.append(at), length.append(to - at), crc.append(zlib.crc32(part)), tokens.append(part)
                at = to
        columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if ids:
            columns.append(pa.array(tokens, pa.binary()))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row for each piece of each text: its ids followed by the separator, cut if longer than ``capacity``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select("doc_id", "text").mapInArrow(lambda x: _pieces(x, tokenizer, capacity, ids), schema)


# --- the plan: a list of (configuration, how many sequences have it); a configuration is ((length, count), ...)

Plan = list[tuple[tuple[tuple[int, int], ...], int]]


def _priced(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The knapsack: for each room the best value and a length chosen for it (0: a token of the room stays empty).

    Of lengths that are as good the longest is chosen, so that the short ones stay for what is hard to fill.
    """
    value, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    sizes = np.flatnonzero(price > 0)[::-1]
    worth = price[sizes]
    for room in range(int(sizes[-1]) if len(sizes) else capacity + 1, capacity + 1):
        k = np.searchsorted(-sizes, -room)
        gain = value[room - sizes[k:]] + worth[k:]
        best = int(gain.argmax())
        if gain[best] >= value[room - 1]:
            value[room], choice[room] = gain[best], sizes[k + best]
        else:
            value[room] = value[room - 1]
    return value, choice


def _best_with(size: int, choice: np.ndarray, capacity: int) -> Counter:
    """The best configuration that has this length."""
    config, room = Counter({size: 1}), capacity - size
    while room > 0:
        config[int(choice[room])] += choice[room] > 0
        room -= int(choice[room]) or 1
    return +config


Amounts = dict[tuple[tuple[int, int], ...], float]


def fractional(sizes: np.ndarray, need: np.ndarray, weight: np.ndarray, capacity: int) -> tuple[Amounts, np.ndarray, float]:
    """Amounts of configurations that cover ``need`` by ``sizes``, none of it twice; what they leave; a lower bound.

    The bound is that of the dual program: the demand at these prices over the dearest configuration's price.
    """
    left, amounts, bound, top, near = need.astype(float), defaultdict(float), 0.0, 0.0, NEAR
    place = np.full(capacity + 1, -1)
    place[sizes] = np.arange(len(sizes))
    for _ in range(PRICINGS):
        there = left > 1e-9
        if not there.any() or near > LAST:
            break
        price = np.zeros(capacity + 1)
        price[sizes] = np.where(there, sizes * np.exp(weight), 0)
        value, choice = _priced(price, capacity)
        if not top:
            top = value[capacity]
            bound = float(need @ price[sizes]) / top
        covered = 0.0
        for i in np.flatnonzero(there)[::-1]:
            size = int(sizes[i])
            if left[i] <= 1e-9 or price[size] + value[capacity - size] < (1 - near) * top:
                continue
            config = _best_with(size, choice, capacity)
            at, counts = place[list(config)], np.array(list(config.values()), float)
            amount = float((left[at] / counts).min())
            amount = np.floor(amount) if amount > 1 else amount
            if amount > 1e-9:
                amounts[tuple(sorted(config.items(), reverse=True))] += amount
                left[at] -= counts * amount
                covered += amount * counts.sum()
        if covered < 0.02 * left.sum():
            near *= 2
    return amounts, left, bound


def _rounded(amounts: Amounts, demand: np.ndarray) -> tuple[Plan, np.ndarray]:
    """Whole configurations, as many as the amounts say and at least one where its pieces are left; the demand left."""
    left, plan = demand.copy(), []
    for config, amount in sorted(amounts.items(), key=lambda x: (-x[1], -sum(s * n for s, n in x[0]), x[0])):
        use = min(max(int(amount + 1e-9), 1), *(int(left[s]) // n for s, n in config))
        if use > 0:
            plan.append((config, use))
            for s, n in config:
                left[s] -= n * use
    return plan, left


def _filled(demand: np.ndarray, capacity: int, opened: Plan = ()) -> Plan:
    """Best fit by decreasing length into sequences of ``opened`` and new ones, equal sequences at a time."""
    groups: dict[int, Counter] = defaultdict(Counter)  # by room left: configurations and how many
    for config, n in opened:
        groups[capacity - sum(s * k for s, k in config)][config] += n
    for size in np.flatnonzero(demand)[::-1].tolist():
        count = int(demand[size])
        room = size
        while count and room < capacity:
            if groups.get(room):
                config, n = next(iter(groups[room].items()))
                each = min(room // size, max(1, count // n))
                use = min(n, count // each)
                groups[room][config] -= use
                if not groups[room][config]:
                    del groups[room][config]
                groups[room - each * size][(*config, (size, each))] += use
                count -= use * each
                if room - each * size >= size:
                    room -= each * size
            else:
                room += 1
        if count:
            each = capacity // size
            full, rest = divmod(count, each)
            if full:
                groups[capacity - each * size][((size, each),)] += full
            if rest:
                groups[capacity - rest * size][((size, rest),)] += 1
    return [(c, n) for by in groups.values() for c, n in by.items()]


@dataclass
class Solution:
    """A plan; the dual program's lower bound on its sequences; pieces that rounding left to best fit."""

    plan: Plan
    bound: float
    left: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.plan)


def solved(demand: np.ndarray, capacity: int) -> Solution:
    """The plan of the fewest sequences over all turns for the histogram ``demand`` (by length, 0 to ``capacity``)."""
    rest = demand.astype(np.int64).copy()
    whole, rest[capacity] = int(rest[capacity]), 0  # these have a sequence each in any plan
    full: Plan = [(((capacity, 1),), whole)] if whole else []
    sizes = np.flatnonzero(rest)
    need, bound, best = rest[sizes], 0.0, None
    for start in STARTS if len(sizes) else ():
        weight = start * np.log(sizes / capacity)
        for _ in range(TURNS):
            amounts, left, low = fractional(sizes, need, weight, capacity)
            bound = max(bound, low)
            plan, over = _rounded(amounts, rest)
            plan = _filled(over, capacity, plan)
            found = Solution(plan, 0.0, int(over.sum()))
            if best is None or (found.sequences, found.left) < (best.sequences, best.left):
                best = found
            if best.sequences <= np.ceil(bound - 1e-6) and best.left <= LEFT * rest.sum():
                break
            # lengths that stay uncovered, and those of configurations with room left, gain weight
            pain = np.zeros(capacity + 1)
            for config, amount in amounts.items():
                room = 1 - sum(s * n for s, n in config) / capacity
                for s, n in config:
                    pain[s] += amount * n * room
            pain = (pain[sizes] + left) / need
            weight = weight + ETA * (pain - pain.mean())
        else:
            continue
        break
    return Solution(full + (best.plan if best else []), whole + bound, best.left if best else 0)


def planned(demand: np.ndarray, capacity: int) -> Plan:
    """Whole configurations for the histogram ``demand``."""
    return solved(demand, capacity).plan


def runs(plan: Plan) -> tuple[np.ndarray, ...]:
    """Runs of ranks of one length that have the same place in sequences of one configuration, by length and rank.

    Columns: the length, the first rank, the first sequence, pieces of the run in a sequence, the first one's offset.
    """
    size_, begin, first, each, offset = [], [], [], [], []
    used, sequence = Counter(), 0
    for config, n in plan:
        at = 0
        for s, k in config:
            size_.append(s), begin.append(used[s]), first.append(sequence), each.append(k), offset.append(at)
            used[s] += n * k
            at += s * k
        sequence += n
    order = np.lexsort((begin, size_))
    return tuple(np.array(x, np.int64)[order] for x in (size_, begin, first, each, offset))


def looked_up(table: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their rank within their length."""
    size_, begin, first, each, offset = table
    low = np.searchsorted(size_, np.arange(capacity + 2))
    run = np.zeros(len(length), np.int64)
    for s in np.unique(length):
        mine = length == s
        a, b = low[s], low[s + 1]
        run[mine] = a + np.searchsorted(begin[a:b], rank[mine], "right") - 1
    turn = rank - begin[run]
    return first[run] + turn // each[run], offset[run] + turn % each[run] * length


def placed(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces."""
    spark = found.sparkSession
    histogram = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    demand = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        demand[size] = n
    table = runs(planned(demand, capacity))
    sent = spark.sparkContext.broadcast(table)  # bounded by the configurations of a plan, not by the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            names = [x for x in batch.schema.names if x != "rank"]
            made = [pa.array(x) for x in looked_up(sent.value, length, rank, capacity)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *made], names=[*names, "sequence_id", "offset"])

    ranked = salted_rank(found, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", int(demand.sum()))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) for each piece of ``docs`` (doc_id, text).

    A text's ids are followed by the separator 0, so null and empty texts give one piece of length 1. A document of
    more than ``capacity`` tokens is cut into pieces of that many, the first piece may be shorter. Every sequence is
    gapless from offset 0. Repeated rows and null doc_ids are packed like others; extra columns are ignored; an empty
    table gives none.
    """
    return placed(written(pieces(docs, tokenizer, capacity, ids), "pieces"), capacity)


def op4(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, sequences of 2048 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
