"""Packing by cutting stock: a linear program over patterns of the length histogram, columns priced by a knapsack.

A pattern is a multiset of lengths that fills a sequence to the last token: ``capacity``, or a power of two below it,
at which no padding is due either. The program covers the histogram with patterns; what no pattern takes is laid end to
end on a line that is cut at every ``capacity`` tokens, which wastes nothing but cuts documents, and a cut costs more
than a sequence. Columns are generated: a knapsack dynamic program over the prices of the program's current basis gives
the patterns that it still lacks, until they could save no more than a small share. Amounts are rounded to whole patterns,
the program is solved again for what rounding leaves, and the rest goes on the line. All of this works on the
histogram, a number for each length; Spark ranks the pieces of each length and the plan says where each rank goes.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import packing
from orrery.llm.common import salted_rank, written
from orrery.llm.packing import ROWS_AT_ONCE, Encoder, looked_up, runs

CAPACITY, SEPARATOR = 2048, 1
#: What a cut costs, in sequences; the share of its cost that the program may miss; pricings, roundings and coverings of a pricing
#: at most.
CUT, GAP, PRICINGS, ROUNDINGS, COVERS = 3.0, 0.01, 60, 8, 3
#: Pivots between two refreshes of the inverse, and cut documents whose keys are broadcast at most.
REFRESH, FEW = 64, 200_000

Pattern = tuple[tuple[int, int], ...]


def targets(capacity: int) -> list[int]:
    """Fills at which a sequence needs no padding, the fullest first."""
    return [capacity, *(1 << k for k in range(capacity.bit_length() - 1, -1, -1) if 1 << k < capacity)]


@dataclass
class Program:
    """The restricted master program: cover ``need`` of each of ``sizes`` by patterns or by the line.

    Every size starts on the line. The inverse of the basis is kept as a matrix and the pivots since it was made.
    """

    sizes: np.ndarray
    need: np.ndarray
    capacity: int
    patterns: list[Pattern] = field(default_factory=list)

    def __post_init__(self):
        m = len(self.sizes)
        self.place = {int(s): i for i, s in enumerate(self.sizes)}
        self.line = self.sizes * (1 + CUT) / self.capacity
        self.basis = np.arange(m)  # below m: the line; m + k: pattern k
        self.cost = self.line.copy()
        self.inverse, self.pivots = np.eye(m), []
        # a little more of each length than there is, never twice the same: ties would let pivots stand still
        self.shaken = self.need + np.random.default_rng(m).uniform(0.001, 0.01, m)
        self.amount, self.price = self.shaken.copy(), self.line.copy()
        self.known: set[Pattern] = set()
        self.rows, self.counts, self.first = [np.arange(m)], [np.ones(m)], list(range(m + 1))
        self.bound = 0.0

    def add(self, pattern: Pattern) -> None:
        if pattern in self.known:
            return
        self.known.add(pattern)
        self.patterns.append(pattern)
        self.rows.append(np.array([self.place[s] for s, _ in pattern]))
        self.counts.append(np.array([float(n) for _, n in pattern]))
        self.first.append(self.first[-1] + len(pattern))

    def _column(self, k: int) -> np.ndarray:
        u = self.inverse[:, self.rows[k]] @ self.counts[k] if k >= len(self.sizes) else self.inverse[:, k].copy()
        for r, eta in self.pivots:
            t = u[r]
            u += t * eta
        return u

    def _refresh(self) -> None:
        if self.pivots:
            rows = np.unique([r for r, _ in self.pivots])
            x = np.zeros((len(self.sizes), len(rows)))
            x[rows, np.arange(len(rows))] = 1
            for r, eta in self.pivots:
                x += np.outer(eta, x[r])
            x[rows, np.arange(len(rows))] -= 1
            self.inverse += x @ self.inverse[rows]
            self.pivots = []
        self.amount = np.maximum(self.inverse @ self.shaken, 0)
        self.price = self.cost @ self.inverse

    def improve(self) -> None:
        """Pivots until no column that is there lowers the cost."""
        m = len(self.sizes)
        flat, counts = np.concatenate([np.arange(m), *self.rows[1:]]), np.concatenate([np.ones(m), *self.counts[1:]])
        cost = np.concatenate([self.line, np.ones(len(self.patterns))])
        rows, numbers = self.rows, self.counts
        self.rows, self.counts = [None] * m + rows[1:], [None] * m + numbers[1:]
        first = np.array(self.first[:-1])
        for _ in range(4 * m + 100):
            gain = np.add.reduceat(self.price[flat] * counts, first) - cost
            k = int(gain.argmax())
            if gain[k] <= 1e-7:
                break
            u = self._column(k)
            ok = u > 1e-7
            if not ok.any():
                break
            ratio = np.full(m, np.inf)
            ratio[ok] = self.amount[ok] / u[ok]
            r = int(ratio.argmin())
            v = np.zeros(m)
            v[r] = 1
            for q, eta in reversed(self.pivots):
                v[q] += v @ eta
            there = np.flatnonzero(v)
            self.price = self.price + (-gain[k] / u[r]) * (v[there] @ self.inverse[there])
            theta = ratio[r]
            self.amount = np.maximum(self.amount - theta * u, 0)
            self.amount[r] = theta
            eta = -u / u[r]
            eta[r] = 1 / u[r] - 1
            self.pivots.append((r, eta))
            self.basis[r], self.cost[r] = k, cost[k]
            if len(self.pivots) >= REFRESH:
                self._refresh()
        self._refresh()
        self.rows, self.counts = rows, numbers

    @property
    def value(self) -> float:
        return float(self.price @ self.need)

    def priced(self) -> bool:
        """Adds the patterns that the basis' prices ask for; whether they may save more than the gap."""
        best, steps = knapsack(self.sizes, self.price, self.need, self.capacity)
        top = max(float(best[t]) for t in targets(self.capacity))
        # prices scaled so that no pattern is worth more than it costs bound the program from below
        self.bound = max(self.bound, float(np.minimum(self.price / max(1.0, top), self.line) @ self.need))
        if self.value - self.bound <= GAP * self.value or top <= 1 + 1e-6:
            return False
        before = len(self.patterns)
        for t in targets(self.capacity):
            if best[t] > 1 + 1e-7:
                self.add(filled(t, steps))
        self._cover()
        return len(self.patterns) > before

    def _cover(self) -> None:
        """Adds patterns worth more than they cost that have enough pieces for each other.

        The longest length first, each is filled up with the lengths that the knapsack values most among those that
        are left, as long as the pattern stays worth its cost, and takes its pieces as often as they last. Columns
        that share no pieces come into the basis together.
        """
        left = self.need.copy()
        for _ in range(COVERS):
            there = np.flatnonzero(left > 0)
            if not len(there):
                break
            sizes, price = self.sizes[there], self.price[there]
            best, _ = knapsack(sizes, price, left[there], self.capacity)
            taken = 0
            for i in range(len(there) - 1, -1, -1):
                room, spare = self.capacity - int(sizes[i]), price[i] + best[self.capacity - sizes[i]] - 1 - 1e-7
                if spare <= 0 or not left[there[i]]:
                    continue
                used = Counter({i: 1})
                free = left[there] > 0
                free[i] = left[there[i]] > 1
                while room:
                    k = int(np.searchsorted(sizes, room, "right"))
                    gain = np.where(free[:k], best[room - sizes[:k]] + price[:k], -np.inf)[::-1]
                    at = k - 1 - int(gain.argmax()) if k else 0
                    if not k or gain[k - 1 - at] < best[room] - spare:
                        break
                    spare -= best[room] - gain[k - 1 - at]
                    room -= int(sizes[at])
                    used[at] += 1
                    free[at] = left[there[at]] > used[at]
                if room:
                    continue
                self.add(tuple(sorted(((int(sizes[k]), n) for k, n in used.items()), reverse=True)))
                times = min(int(left[there[k]]) // n for k, n in used.items())
                taken += times
                for k, n in used.items():
                    left[there[k]] -= n * times
            if not taken:
                break

    def amounts(self) -> dict[Pattern, float]:
        m, amount = len(self.sizes), self.inverse @ self.need
        return {self.patterns[k - m]: float(x) for k, x in zip(self.basis, amount, strict=True) if k >= m and x > 1e-6}


Steps = list[tuple[int, int, np.ndarray]]


def knapsack(sizes: np.ndarray, price: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, Steps]:
    """The best value of lengths, each up to ``most`` times, that fill each room exactly (-inf: none do), and the steps
    that lead there: a length, how often it is taken at once, and the rooms where taking it is better."""
    best, steps = np.full(capacity + 1, -np.inf), []
    best[0] = 0
    for size, worth, n in zip(sizes[::-1].tolist(), price[::-1].tolist(), np.minimum(most, capacity // sizes)[::-1].tolist(), strict=True):
        part = 1
        while n > 0:
            k = min(part, n)
            gain = best[: -k * size] + k * worth
            better = gain > best[k * size :]
            best[k * size :] = np.where(better, gain, best[k * size :])
            steps.append((size, k, better))
            n, part = n - k, 2 * part
    return best, steps


def filled(room: int, steps: Steps) -> Pattern:
    config: Counter[int] = Counter()
    for size, k, better in reversed(steps):
        if room >= k * size and better[room - k * size]:
            config[size] += k
            room -= k * size
    return tuple(sorted(config.items(), reverse=True))


def program(need: np.ndarray, capacity: int) -> Program | None:
    """The solved program for a histogram (by length, 0 to ``capacity`` - 1), None of an empty one."""
    sizes = np.flatnonzero(need)
    if not len(sizes):
        return None
    made = Program(sizes, need[sizes], capacity)
    for _ in range(PRICINGS):
        if not made.priced():
            break
        made.improve()
    return made


@dataclass
class Plan:
    """Whole patterns and how many sequences have them; what is left for the line, by length; the program's cost and
    its lower bound."""

    patterns: list[tuple[Pattern, int]]
    rest: np.ndarray
    cost: float
    bound: float


def planned(demand: np.ndarray, capacity: int) -> Plan:
    """The plan for the histogram ``demand`` (by length, 0 to ``capacity``)."""
    left = demand.astype(np.int64).copy()
    whole, left[capacity] = int(left[capacity]), 0
    plan: Counter[Pattern] = Counter()
    cost = bound = 0.0
    for turn in range(ROUNDINGS):
        made = program(left, capacity)
        if made is None:
            break
        if not turn:
            cost, bound = made.value, made.bound
        before = int(left.sum())
        amounts = sorted(made.amounts().items(), key=lambda x: (-x[1], x[0]))
        for up in (0, 1):  # whole parts first, then one more of each pattern whose pieces are there
            for pattern, amount in amounts:
                use = min(up or int(amount + 1e-7), *(int(left[s]) // n for s, n in pattern))
                if use > 0:
                    plan[pattern] += use
                    for s, n in pattern:
                        left[s] -= n * use
        if before - int(left.sum()) < 0.05 * before:
            break
    full = [(((capacity, 1),), whole)] if whole else []
    return Plan(full + sorted(plan.items(), reverse=True), left, whole + cost, whole + bound)


# --- the documents


def _ids(encoder: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Ids of each text, the separator after them."""
    end = np.array([SEPARATOR], "<u4").tobytes()
    parts = (encoder([t or "" for t in texts.slice(a, ROWS_AT_ONCE).to_pylist()]) for a in range(0, len(texts), ROWS_AT_ONCE))
    return (x + end for x in chain.from_iterable(parts))


def _encoder(tokenizer: str) -> Encoder:
    return packing._ENCODERS.get(tokenizer) or packing._ENCODERS.setdefault(tokenizer, Encoder(tokenizer))


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(tokenizer)
    for batch in batches:
        rows, start, length, crc, tokens = [], [], [], [], []
        for i, ids in enumerate(_ids(encoder, batch.column(2))):
            n = len(ids) // 4
            for at in range(0, n, capacity):
                part = ids[4 * at : 4 * (at + capacity)]
                rows.append(i), start.append(at), length.append(len(part) // 4), crc.append(zlib.crc32(part)), tokens.append(n)
        at = pa.array(rows, pa.int64())
        columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "start", "length", "ids_crc32", "doc_tokens"])


def _line_sequence(at: np.ndarray, total: int, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, start and end of the line's sequence that holds the token at ``at``.

    The line is cut at every ``capacity`` and its tail into powers of two; no table grows with the line.
    """
    full, tail = divmod(total, capacity)
    last = full * capacity + np.concatenate([[0], np.cumsum([1 << k for k in range(tail.bit_length() - 1, -1, -1) if tail >> k & 1], dtype=np.int64)]).astype(np.int64)
    inside = np.minimum(np.searchsorted(last, at, "right") - 1, max(len(last) - 2, 0))
    early = at < full * capacity
    start = np.where(early, at // capacity * capacity, last[inside])
    end = np.where(early, start + capacity, last[np.minimum(inside + 1, len(last) - 1)])
    return np.where(early, at // capacity, full + inside), start, end


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for each piece of ``docs`` (doc_id, text).

    A text's ids are followed by the separator 1, so null and empty texts give one piece of length 1. Documents are cut
    at every ``capacity`` tokens, and where the line is cut. Every sequence is gapless from offset 0 and holds
    ``capacity`` tokens or a power of two, so there is no padding at all. Repeated rows and null doc_ids are packed
    like others; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, start long, length long, ids_crc32 long, doc_tokens long"
    found = written(rows.mapInArrow(lambda x: _pieces(x, tokenizer, capacity), schema), "cutting")
    demand = np.zeros(capacity + 1, np.int64)
    for r in found.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``capacity`` rows
        demand[r.length] = r.n
    plan = planned(demand, capacity)
    sequences = sum(n for _, n in plan.patterns)
    taken = demand - plan.rest
    base = np.cumsum(plan.rest * np.arange(capacity + 1)) - plan.rest * np.arange(capacity + 1)
    total = int((plan.rest * np.arange(capacity + 1)).sum())
    sent = spark.sparkContext.broadcast((runs(plan.patterns), taken, base))  # bounded by the lengths, not by the pieces

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, taken, base = sent.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = rank < taken[length]
            sequence, offset, line = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64), np.full(len(rank), -1)
            sequence[own], offset[own] = looked_up(table, length[own], rank[own], capacity)
            at = base[length[~own]] + (rank[~own] - taken[length[~own]]) * length[~own]
            number, start, end = _line_sequence(at, total, capacity)
            sequence[~own], offset[~own] = sequences + number, at - start
            line[~own] = np.where(at + length[~own] > end, at, -1)  # cut: it goes over its sequence's end
            names = [x for x in batch.schema.names if x != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *map(pa.array, (sequence, offset, line))], names=[*names, "sequence_id", "offset", "line"])

    ranked = salted_rank(found, ["length"], ["doc_id", "text_key", "start", "ids_crc32"], "rank", int(demand.sum()))
    every = written(ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long, line long"), "placed")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole = every.where("line < 0").select(*columns)
    if not total:
        return whole
    # documents that the line cuts are encoded once more: fewer than its sequences
    cut = every.where("line >= 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("start").alias("__start"), "length", "line")
    wanted = cut.select("__id", "__key").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    few = total // capacity + capacity.bit_length() <= FEW
    texts = rows.join(F.broadcast(wanted) if few else wanted, same, "left_semi").groupBy("doc_id", "text_key").agg(F.first("text").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            start, length, line = (batch.column(c).to_pylist() for c in ("__start", "length", "line"))
            rows, out = [], []
            for i, ids in enumerate(_ids(encoder, batch.column(batch.schema.names.index("text")))):
                at, left = start[i], length[i]
                while left:
                    (number,), (begin,), (end,) = _line_sequence(np.array([line[i] + length[i] - left]), total, capacity)
                    here = line[i] + length[i] - left
                    n = min(left, int(end) - here)
                    rows.append(i)
                    out.append((at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), len(ids) // 4, sequences + int(number), here - int(begin)))
                    at, left = at + n, left - n
            made = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.names.index("doc_id")).take(pa.array(rows, pa.int64())), *made], names=columns)

    parts = texts.join(cut, same).select("doc_id", "text", "__start", "length", "line")
    return whole.unionByName(parts.mapInArrow(split, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"))


def op13(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, sequences of 2048 tokens."""
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
