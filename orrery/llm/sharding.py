"""Sharding by the minimax contiguous partition: the smallest capacity for which greedy cuts make few enough shards.

The atoms are groups of equal texts, ordered by a hash of the text. Their sizes stay on the cluster; the driver sees
sums over cells, intervals of the hash range, at most FAN of them a level. With whole cells as atoms a binary search
gives a capacity that is surely enough; with that and a capacity that surely is not too large, each cut lies in a
window of the order. Only cells inside windows are split further, until they are single groups; then the capacity
is that over all groups. Within that capacity the cuts are put where the shards come out evenly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import salted_rank, written

#: Bits of the hash that one level of cells resolves, and the groups that the windows may hold to be fetched as they are.
BITS, FETCH = 16, 200_000


def greedy_cuts(ends: np.ndarray, capacity: int) -> list[int]:
    """Places behind which to cut so that each part has at most ``capacity``; ``ends`` are running sums of sizes."""
    cuts, used, at = [], 0, 0
    while at < len(ends):
        at = int(np.searchsorted(ends, used + capacity, "right"))
        if at == 0 or ends[at - 1] <= used:
            raise ValueError("an atom is larger than the capacity")
        used = int(ends[at - 1])
        cuts.append(at)
    return cuts


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """Binary search for the least capacity with which ``greedy_cuts`` makes at most ``shards`` parts."""
    if not len(sizes):
        return 0
    ends = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(ends[-1]) // shards)), int(ends[-1])
    while low < high:
        middle = (low + high) // 2
        if len(greedy_cuts(ends, middle)) <= shards:
            high = middle
        else:
            low = middle + 1
    return low


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts that keep to ``capacity`` as the greedy ones do, each as near as may be to an even share of what is left.

    Greedy cuts from the end give the least that must lie before each cut, so that the rest still fits.
    """
    total = int(ends[-1])
    edges = np.concatenate([[0], ends])
    need = [total]
    for _ in range(shards):
        need.append(int(edges[np.searchsorted(edges, need[-1] - capacity)]))
    cuts, used = [], 0
    for left in range(shards, 0, -1):
        low, high, ideal = max(need[left - 1], used), used + capacity, used + (total - used) / left
        a, b = int(np.searchsorted(edges, low)), int(np.searchsorted(edges, high, "right")) - 1
        at = a + int(np.abs(edges[a : b + 1] - ideal).argmin())
        cuts.append(at)
        used = int(edges[at])
    return cuts


def _windows(sizes: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Which atoms a cut may have to split, for every capacity from ``low`` to ``high``."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    least, most = 0, 0
    inside = np.zeros(len(sizes), bool)
    for _ in range(shards):
        k = int(np.searchsorted(ends, least + low, "right"))
        least, most = int(ends[k - 1]) if k else 0, min(most + high, int(ends[-1]))
        inside |= (ends > least) & (begins < most)
    return inside


def boundaries(groups: DataFrame, shards: int, bits: int = BITS, fetch: int = FETCH) -> list[int]:
    """The last hash of every shard but the last, for a written table of groups (hash, bytes)."""

    def cells(of: DataFrame, shift: int) -> list[tuple[int, int, int, int]]:
        """(first hash, last hash, bytes, groups) of each cell, at most 2 ** bits for each cell that is split."""
        rows = of.groupBy(F.shiftright("hash", shift).alias("cell")).agg(
            F.min("hash").alias("a"), F.max("hash").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("n"))
        return [(r.a, r.b, r.s, r.n) for r in rows.collect()]

    largest = groups.agg(F.max("bytes")).first()[0]
    if largest is None:
        return []
    shift = 64 - bits
    atoms = sorted(cells(groups, shift))
    while True:
        sizes = np.array([x[2] for x in atoms], np.int64)
        high = smallest_capacity(sizes, shards)
        low = max(int(largest), -(-int(sizes.sum()) // shards))
        if all(x[3] == 1 for x in atoms):
            break
        inside = _windows(sizes, min(low, high), high, shards)
        split = [x for x, i in zip(atoms, inside, strict=True) if i and x[3] > 1]
        if not split:
            break
        spans = _joined(atoms, inside)
        wanted = F.lit(False)
        for a, b in spans:
            wanted = wanted | F.col("hash").between(a, b)
        few = sum(x[3] for x, i in zip(atoms, inside, strict=True) if i) <= fetch
        shift = 0 if few else max(0, shift - min(bits, 6))
        atoms = sorted([x for x, i in zip(atoms, inside, strict=True) if not i] + cells(groups.where(wanted), shift))
    cuts = even_cuts(np.cumsum(sizes), high, shards)
    return [atoms[c - 1][1] for c in cuts[:-1] if c]


def _joined(atoms, inside) -> list[tuple[int, int]]:
    """Hash ranges of runs of marked atoms: at most one for each shard."""
    spans: list[tuple[int, int]] = []
    running = False
    for x, i in zip(atoms, inside, strict=True):
        if i and running:
            spans[-1] = (spans[-1][0], x[1])
        elif i:
            spans.append((x[0], x[1]))
        running = bool(i)
    return spans


def assign(docs: DataFrame, shards: int = 24) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text).

    Size is the text's UTF-8 bytes (null: none) plus 8. Equal texts go to one shard (null counts as empty), and the
    largest shard is as small as any contiguous partition of the groups in hash order allows. Slots of a shard run
    from 0 without gaps. With fewer groups than shards some shards stay empty; repeated rows and null doc_ids get
    slots of their own; extra columns are ignored; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
    )
    rows = written(rows, "sizes")
    groups = written(rows.groupBy("hash").agg(F.sum("size").alias("bytes")), "groups")
    shard = F.lit(0)
    for last in boundaries(groups, shards):
        shard = shard + F.when(F.col("hash") > last, 1).otherwise(0)
    sharded = rows.select("doc_id", "size", "text_crc32", shard.alias("shard"))
    return salted_rank(sharded, ["shard"], ["doc_id", "text_crc32"], "slot", rows.count())


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> DataFrame:
    """Writes ``docs`` (doc_id unique) below ``path``, a folder for each shard; returns the assignment."""
    where = assign(docs, shards)
    docs.join(where.select(F.col("doc_id").alias("__id"), "shard", "slot"), F.col("doc_id") == F.col("__id")).drop("__id").write.partitionBy("shard").parquet(path)
    return where


def op6(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` in 24 shards of near equal bytes."""
    placed = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
