"""Near-duplicate documents by HyperMinHash.

A text is the set of its word shingles. One 64-bit hash a shingle picks a register and gives the register's value:
the leading zeros and the next mantissa bits of the smallest hash, 16 bits in all. Registers that no shingle picked
take a filled one's value, by a minwise choice, so small sets band as large ones do. Bands of registers give
candidates; a pair's registers then estimate its Jaccard similarity, corrected for equal values of different
minima; what may reach the threshold is confirmed on the full sets.

Texts with equal sets are one node from the start. In a bucket every node is paired with one pivot, then, where
it has several components, with another; only nodes of a bucket that still lie in different components are then
compared one with another, in blocks where they are many. So the copies of a large group cost as many pairs as there
are copies, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import shared, written
from orrery.llm.components import components
from orrery.llm.words import NOT_SPACE, Words, buffers, chunks, mixed

BANDS, ROWS = 48, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Sets of up to EXACT shingles, of both together, are compared whole. Of larger ones an estimate that lies MARGIN below
#: the threshold ends the pair; its deviation is 0.024 to 0.03 there, as measured.
EXACT, MARGIN = 4096, 0.25
#: Nodes of a bucket up to which its open pairs are rows; beyond, blocks of these sizes meet. Cells of a block's matrix.
FEW, X_BLOCK, Y_BLOCK, CELLS = 24, 256, 1024, 8 << 20
_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)
_ALONE = np.uint64(0xA0761D6478BD642F)
_RNG = np.random.default_rng(977)
_PRIORITY = _RNG.integers(0, 2**32, (REGISTERS, REGISTERS), dtype=np.uint32)
_MIX = _RNG.integers(1, 2**62, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes."""
    data, offsets = buffers(texts)
    for a, b in chunks(offsets):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], NOT_SPACE)
        h = w.hashes()
        rolled = h.copy()
        for k in range(1, size):
            n = max(len(h) - k, 0)
            rolled[:n] = mixed(rolled[:n] * _NEXT + h[k:])
        for first, n in zip(w.first[:-1].tolist(), w.n.tolist(), strict=True):
            if n >= size:
                yield np.unique(rolled[first : first + n - size + 1])
            elif n:
                whole = h[first : first + 1]
                for k in range(1, n):
                    whole = mixed(whole * _NEXT + h[first + k : first + k + 1])
                yield mixed(whole ^ np.full(1, n, np.uint64) * _ALONE)
            else:
                yield h[:0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """REGISTERS values of 16 bits: leading zeros (6) and mantissa (MANTISSA) of each register's smallest hash."""
    pick = ((shingles >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
    low = mixed(shingles) & np.uint64(0xFFFFFFFF)
    order = np.lexsort((low, pick))
    pick, low = pick[order], low[order]
    first = np.flatnonzero(np.diff(pick, prepend=-1))
    filled, least = pick[first], low[first].astype(np.int64)
    bits = np.frexp(least.astype(np.float64))[1].astype(np.int64)  # of the value; 0 for 0
    zeros = 32 - bits
    rest = least - (np.int64(1) << np.maximum(bits - 1, 0)) * (bits > 0)
    shift = bits - 1 - MANTISSA
    mantissa = np.where(shift >= 0, rest >> np.maximum(shift, 0), rest << np.maximum(-shift, 0))
    out = np.zeros(REGISTERS, np.uint16)
    values = (zeros << MANTISSA | mantissa & ((1 << MANTISSA) - 1)).astype(np.uint16)
    out[filled] = values
    if len(filled) < REGISTERS:
        empty = np.ones(REGISTERS, bool)
        empty[filled] = False
        out[empty] = values[_PRIORITY[np.ix_(empty, filled)].argmin(axis=1)]
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of registers."""
    return mixed((values.reshape(BANDS, ROWS).astype(np.uint64) * _MIX).sum(axis=1, dtype=np.uint64) + _BAND)


@lru_cache(maxsize=4096)
def _collision(a: int, b: int) -> float:
    """How often registers of sets of 2^(a/4) and 2^(b/4) shingles a register agree though their minima differ."""
    na, nb = 2.0 ** (a / 4), 2.0 ** (b / 4)
    total = 0.0
    for zeros in range(32):
        low = 2.0 ** -(zeros + 1) * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
        high = low + 2.0 ** -(zeros + 1) / (1 << MANTISSA)
        pa_, pb_ = (1 - low) ** na - (1 - high) ** na, (1 - low) ** nb - (1 - high) ** nb
        total += float((pa_ * pb_).sum())
    return total


def estimate(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> float:
    """Jaccard similarity from registers, less the chance collisions that are to be expected."""
    a, b = (int(4 * np.log2(max(n / REGISTERS, 1))) for n in (nx, ny))
    chance = _collision(min(a, b), max(a, b))
    return max(0.0, ((x == y).mean() - chance) / (1 - chance))


def _sketched(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sig, buckets = [], [], []
        for s in shingle_sets(batch.column(1), size):
            n.append(len(s))
            sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            buckets.append(bands(registers(s)).view(np.int64) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
            names=["doc_id", "h", "n", "sig", "buckets"],
        )


def _full(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets, regs = [], []
        for s in shingle_sets(batch.column(1), size):
            sets.append(s.tobytes())
            regs.append(registers(s).tobytes() if len(s) else b"")
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "shingles", "regs"])


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        sx, sy, rx, ry = (batch.column(c).to_pylist() for c in ("sx", "sy", "rx", "ry"))
        for i in range(batch.num_rows):
            x, y = np.frombuffer(sx[i], np.uint64), np.frombuffer(sy[i], np.uint64)
            ok = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
            if ok and (len(x) + len(y) <= EXACT or estimate(np.frombuffer(rx[i], np.uint16), np.frombuffer(ry[i], np.uint16), len(x), len(y)) >= percent / 100 - MARGIN):
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok = 100 * both >= percent * (len(x) + len(y) - both)
            else:
                ok = False
            keep.append(ok)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(keep)], names=["a", "b", "linked"])


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for each row of ``docs`` (doc_id, text).

    Links texts whose sets of ``size``-word shingles have 100 * intersection >= ``percent`` * union; component_id is
    the smallest doc_id that links reach, kept says that it is the row's own. Words end at ASCII white space, A-Z are
    lower-cased; a text of fewer than ``size`` words has one shingle, the whole. Null texts and texts without words
    have n_shingles 0, link with nothing and are kept. Rows with one doc_id are one document and stay repeated; where
    their texts differ, links of any of them are links of the document. A null doc_id comes back as it is, its own
    component (null), kept. text_hash is Spark's xxhash64 of the text. Extra columns are ignored; an empty table gives
    none.
    """
    named = docs.select("doc_id", "text")
    hashed = named.select("doc_id", "text", F.xxhash64("text").alias("h"))
    seen = written(hashed.mapInArrow(lambda x: _sketched(x, size), "doc_id long, h long, n long, sig binary, buckets array<long>"), "sketches")
    ids = seen.where("sig IS NOT NULL AND doc_id IS NOT NULL")
    reps = ids.groupBy("sig", shared(F.col("sig")).alias("__s")).agg(F.min("doc_id").alias("rep"))
    rows = ids.select("sig", "doc_id", "buckets").join(reps.select(F.col("sig").alias("rep_sig"), "rep"), (F.col("sig") == F.col("rep_sig")) & (F.col("doc_id") == F.col("rep")))
    placed = rows.select("doc_id", F.explode("buckets").alias("bucket"))
    # a document with several texts is one node with the buckets of all that it represents
    several = ids.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("sig").alias("s"), F.max("sig").alias("t")).where("rows > 1")
    several = written(several.select("doc_id", (F.col("s") != F.col("t")).alias("differ")), "repeated")
    again = not several.isEmpty()
    placed = placed.distinct() if again else placed
    shared_by = placed.groupBy("bucket", shared(F.col("bucket")).alias("__s")).agg(F.count("*").alias("c"), F.min("doc_id").alias("pivot")).where("c > 1")
    crowd = written(placed.join(shared_by.select("bucket", "pivot"), "bucket"), "buckets")
    links = _links(named.join(several.select("doc_id"), "doc_id", "left_anti").unionByName(named.join(several.select("doc_id"), "doc_id", "left_semi").distinct()) if again else named, crowd, size, percent)
    if again:  # its texts are linked through it, though others represent them
        own = ids.select("sig", "doc_id").join(several.where("differ").select("doc_id"), "doc_id", "left_semi").distinct()
        own = own.join(reps.select("sig", "rep"), "sig").where("doc_id != rep").select(F.greatest("doc_id", "rep").alias("a"), F.least("doc_id", "rep").alias("b"))
        links = links.unionByName(own)
    joined = components(links)
    of_rep = reps.select("sig", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    of_sig = of_rep.select("sig", F.coalesce("component", "rep").alias("component"))
    out = seen.select("doc_id", "h", "n", "sig").join(of_sig, "sig", "left")
    component = F.when(F.col("sig").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), F.col("h").alias("text_hash"))


def _links(docs: DataFrame, crowd: DataFrame, size: int, percent: int) -> DataFrame:
    """Confirmed pairs (a, b), a > b, that connect all that links connect."""
    wanted = crowd.select("doc_id").distinct()
    texts = docs.join(wanted, "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda x: _full(x, size), "doc_id long, shingles binary, regs binary")
    sets = written(sets, "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sx"), F.col("regs").alias("rx"))
        y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sy"), F.col("regs").alias("ry"))
        both = pairs.join(x, "a").join(y, "b")
        return written(both.mapInArrow(lambda z: _confirmed(z, percent), "a long, b long, linked boolean"), "confirmed")

    def unlinked(found: DataFrame) -> DataFrame:
        """The crowd with components, buckets of one component left out."""
        parts = components(found.where("linked").select("a", "b")).withColumnRenamed("node", "doc_id")
        now = crowd.select("doc_id", "bucket").join(parts, "doc_id", "left").select("doc_id", "bucket", F.coalesce("component", "doc_id").alias("part"))
        open_ = now.groupBy("bucket", shared(F.col("bucket")).alias("__s")).agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p != q")
        return now.join(open_.select("bucket"), "bucket", "left_semi")

    tested = confirm(_pairs(crowd.select(F.col("doc_id").alias("x"), F.col("pivot").alias("y"))))
    left = written(unlinked(tested), "open")
    if left.isEmpty():
        return tested.where("linked").select("a", "b")
    chance = F.xxhash64("doc_id", "bucket")
    best = left.groupBy("bucket", shared(F.col("bucket")).alias("__s")).agg(F.max_by(F.struct("doc_id", "part"), chance).alias("best"))
    pairs = left.join(best.select("bucket", "best"), "bucket").where("part != best.part")
    fresh = _pairs(pairs.select(F.col("doc_id").alias("x"), F.col("best.doc_id").alias("y"))).join(tested, ["a", "b"], "left_anti")
    tested = written(tested.unionByName(confirm(fresh)), "confirmed")
    left = written(unlinked(tested), "open")
    counts = left.groupBy("bucket", "part").agg(F.count("*").alias("c")).groupBy("bucket", shared(F.col("bucket")).alias("__s"))
    counts = counts.agg(F.sum("c").alias("n"), F.max_by("part", "c").alias("main"), F.max("c").alias("c")).drop("__s")
    left = left.join(counts, "bucket")
    few = left.where(F.col("n") <= FEW)
    x = few.select("bucket", F.col("doc_id").alias("x"), F.col("part").alias("px"))
    y = few.select("bucket", F.col("doc_id").alias("y"), F.col("part").alias("py"))
    rest = _pairs(x.join(y, "bucket").where("x > y AND px != py"))
    found = confirm(rest.join(tested, ["a", "b"], "left_anti")).where("linked").select("a", "b")
    return tested.where("linked").select("a", "b").unionByName(found).unionByName(_blocks(left.where(F.col("n") > FEW), sets, percent))


def _blocks(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed pairs of buckets with many nodes: those outside a bucket's main part against all of it.

    Blocks of one side meet blocks of the other, and only links leave a task: rows grow with a bucket's nodes times
    the blocks that meet them, not with its pairs.
    """
    x_blocks = F.ceil((F.col("n") - F.col("c")) / X_BLOCK).cast("int")
    y_blocks = F.ceil(F.col("n") / Y_BLOCK).cast("int")
    place = F.abs(F.xxhash64("doc_id"))
    whole = left.join(sets.select("doc_id", "shingles"), "doc_id")
    x = whole.where("part != main").select("bucket", "doc_id", "part", "shingles", (place % x_blocks).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), y_blocks - 1)).alias("j"))
    y = whole.select("bucket", "doc_id", "part", "shingles", F.explode(F.sequence(F.lit(0), x_blocks - 1)).alias("i"), (place % y_blocks).cast("int").alias("j"))
    x, y = (side.toDF(*side.columns) for side in (x, y))
    keys = ["bucket", "i", "j"]
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInArrow(lambda p, q: _block(p, q, percent), "a long, b long").distinct()


def _block(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    xs, ys = ([np.frombuffer(s, np.uint64) for s in t.column("shingles").to_pylist()] for t in (left, right))
    (xi, xp), (yi, yp) = ((t.column("doc_id").to_numpy(), t.column("part").to_numpy()) for t in (left, right))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 0
    while step < len(xs) and len(ys):
        to, known = step + 1, np.unique(xs[step])
        while to < len(xs) and (to - step) < 256 and len(known) * (to - step) < CELLS:
            known, to = np.union1d(known, xs[to]), to + 1
        rows = _incidence(xs[step:to], known)
        width = max(1, CELLS // len(known))
        for c in range(0, len(ys), width):
            part = ys[c : c + width]
            both = rows @ _incidence(part, known).T
            total = np.array([len(x) for x in xs[step:to]])[:, None] + np.array([len(y) for y in part])[None, :]
            i, j = np.nonzero((100 * both >= percent * (total - both)) & (xp[step:to, None] != yp[None, c : c + width]))
            a.append(xi[step + i]), b.append(yi[c + j])
        step = to
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _incidence(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), np.float32)
    for row, s in enumerate(sets):
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        out[row, at[known[at] == s]] = 1
    return out


def _pairs(xy: DataFrame) -> DataFrame:
    return xy.where("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def op10(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents``, two-word shingles, similarity 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80).drop("text_hash")


#: DuckDB's answer to the same question: all pairs of sets that share a shingle, then reachability.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE array_to_string(list_slice(w, i, i + 1), ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n a ON a.doc_id = p.a JOIN n b ON b.doc_id = p.b
  WHERE 100 * common >= 80 * (a.n + b.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id)
"""
