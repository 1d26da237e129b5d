"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

Archives are written by Spark's text writer, one record a row, so any store that Spark writes to will do. Reading
splits files at the record magic wherever Spark's byte ranges begin. Each piece that starts with the magic is a
candidate and names its successor: its own offset plus header and content length. Magic inside a payload makes false
candidates. In a range, a walk from the back gives each candidate its exit, the first offset beyond the range that its
chain reaches; pointer jumping over exits, from the start of each file, finds where the true chain enters each range,
and only records on it stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.common import scratch_path, shared, written

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One WARC record a row of ``pages`` (page_id, url, html), as text without the closing line ends.

    Of pages with equal payloads of at least ``least_bytes`` bytes that with the smallest page_id is the response
    and the others revisit it; every smaller payload is a response. Pages without an id and repeated rows of the
    smallest page_id are responses; pages of one id with different payloads are judged each.
    """
    payload = F.coalesce("html", F.lit(""))
    page = pages.select("page_id", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ").alias("url"), payload.alias("html"))
    page = page.withColumns({"n": F.octet_length("html").cast("long"), "digest": base32_sha1(F.encode("html", "UTF-8"))})
    least = page.where((F.col("n") >= least_bytes) & F.col("page_id").isNotNull()).groupBy(F.col("digest").alias("d"), shared(F.col("digest")).alias("__s")).agg(F.min("page_id").alias("original"))
    chosen = written(page.select("page_id", "digest").join(least.select("d", "original"), F.col("digest") == F.col("d")).where("page_id != original").select(F.col("page_id").alias("again"), "d", "original").distinct(), "revisits")
    page = page.join(chosen, (F.col("page_id") == F.col("again")) & (F.col("digest") == F.col("d")), "left").withColumn("original", F.when(F.col("n") >= least_bytes, F.col("original")))
    revisit = F.col("original").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("html"))
    header = [
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("original").cast("string"), F.lit(">\r\nX-Payload-Length: "), F.col("n").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return page.select(F.concat(F.lit(MAGIC), F.concat_ws("\r\n", *header), F.lit(END), body).alias("value"))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes ``pages`` as uncompressed archives below ``path``."""
    records(pages, least_bytes).write.option("lineSep", END).text(path)


# --- reading

_CANDIDATES = "file string, block long, seq long, rel long, span long, succ long, rest long, page_id long, url string, type string, digest string, refers_to long, payload_bytes long, bad boolean, payload binary"


def _field(head: dict[bytes, bytes], name: bytes) -> bytes:
    return head.get(name, b"")


def _id(value: bytes) -> int | None:
    number = value[len(b"<urn:page:") : -1]
    return int(number) if value.startswith(b"<urn:page:") and number.lstrip(b"-").isdigit() else None


def _parsed(piece: bytes) -> tuple[int, int, dict[bytes, bytes]] | None:
    """Header length (with the empty line), content length and fields of what follows a magic."""
    end = piece.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {}
    for line in piece[:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        head[name.strip().lower()] = value.strip()
    size = _field(head, b"content-length")
    return (end + 4, int(size), head) if size.isdigit() and len(size) < 16 else None


def _scan(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Pieces between magics, in the order of the file range that they come from."""
    last, rel, seq = None, 0, 0
    schema = _arrow(_CANDIDATES)
    for batch in batches:
        rows = []
        for piece, file, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, block) != last:
                last, rel, seq = (file, block), 0, 0
            span = len(piece) + len(MAGIC)
            row = dict.fromkeys(schema.names) | {"file": file, "block": block, "seq": seq, "rel": rel, "span": span, "bad": False}
            if not (block == 0 and seq == 0):  # before the first magic of a file is no record
                found = _parsed(piece)
                if found is not None:
                    at, size, head = found
                    row |= {"succ": rel + at + size + 4, "rest": at + size + 4 - len(piece)}
                    row |= {"page_id": _id(_field(head, b"warc-record-id")), "url": _field(head, b"warc-target-uri").decode(errors="replace"), "type": _field(head, b"warc-type").decode(errors="replace")}
                    row |= {"refers_to": _id(_field(head, b"warc-refers-to"))}
                    if at + size + 4 == len(piece):
                        row |= _content(piece[at : at + size], head, payload)
            rows.append(row)
            rel, seq = rel + span, seq + 1
        yield pa.RecordBatch.from_pylist(rows, schema)


def _content(data: bytes, head: dict[bytes, bytes], payload: bool) -> dict:
    """What a record says of its payload; a response's own bytes decide, and must match the digest it states."""
    stated = _field(head, b"warc-payload-digest").removeprefix(b"sha1:").decode(errors="replace")
    if _field(head, b"warc-type") == b"revisit":
        size = _field(head, b"x-payload-length")
        return {"digest": stated, "payload_bytes": int(size) if size.isdigit() else None, "payload": None}
    digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
    return {"digest": digest, "payload_bytes": len(data), "bad": bool(stated) and stated != digest, "payload": data if payload else None}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in ddl.split(", "))])


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to, valid[, payload] of each record below ``path``.

    Digest and length are of the bytes read; a revisit, which has none, states its original's. ``valid`` is false
    where a response's bytes do not match the digest it states. Bytes that no chain from a file's start reaches are
    no records; an empty folder gives none.
    """
    parts = spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    found = written(parts.mapInArrow(lambda x: _scan(x, payload), _CANDIDATES), "candidates")
    ranges = found.groupBy("file", "block").agg(F.sum("span").alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = ranges.withColumn("base", F.coalesce(F.sum("bytes").over(before), F.lit(0))).drop("bytes")
    # an offset is that of the bytes behind the magic, less the magic: a piece at rel begins its record there
    at = found.select("file", "block", "seq", "rel", "succ").join(base, ["file", "block"])
    start = F.col("base") + F.col("rel") - len(MAGIC)
    nodes = at.where("succ IS NOT NULL").select("file", "block", "seq", start.alias("start"), (F.col("base") + F.col("succ")).alias("succ"))
    walked = written(nodes.groupBy("file", "block").applyInArrow(_exits, "file string, block long, seq long, start long, succ long, exit long"), "exits")
    entries = _entries(walked)
    reached = walked.join(entries.select("file", "block", "entry"), ["file", "block"]).groupBy("file", "block").applyInArrow(_reached, "file string, block long, seq long, start long, succ long")
    kept = written(reached, "reached")
    same = ["file", "block", "seq"]
    plain = found.where("rest = 0").join(kept.select(*same), same, "left_semi")
    columns = ["page_id", "url", F.col("type").alias("record_type"), "payload_bytes", F.col("digest").alias("payload_digest"), "refers_to", (~F.col("bad")).alias("valid"), *["payload"] * payload]
    open_ = written(found.where("rest > 0").select(*same).join(kept, same), "open")
    whole = plain.select(*columns)
    return whole if open_.isEmpty() else whole.unionByName(_pieced(parts, found, base, open_, payload).select(*columns))


def _exits(rows: pa.Table) -> pa.Table:
    """Where the chain of each candidate of a range leaves the range."""
    order = rows.sort_by("start")
    starts, succ = order.column("start").to_pylist(), order.column("succ").to_pylist()
    known = dict.fromkeys(starts)
    for s, t in zip(reversed(starts), reversed(succ), strict=True):
        known[s] = known.get(t, t) if t in known else t
    return order.append_column("exit", pa.array([known[s] for s in starts], pa.int64()))


def _entries(walked: DataFrame) -> DataFrame:
    """file, block, entry: the record by which the chain from a file's start enters a range."""
    targets = walked.select("file", F.col("exit").alias("start")).distinct()
    roots = walked.where("start = 0").select("file", "start")
    jumps = walked.select("file", "block", "start", "exit").join(targets.unionByName(roots).distinct(), ["file", "start"], "left_semi")
    jumps = written(jumps, "jumps")
    places = jumps.select("file", "block", "start")
    now, n = written(roots.distinct(), "entries"), 0
    jumps = jumps.select("file", "start", "exit")
    while True:  # twice as many steps of every chain in each turn
        ahead = now.join(jumps, ["file", "start"]).select("file", F.col("exit").alias("start")).join(places.select("file", "start"), ["file", "start"], "left_semi")
        now = written(now.unionByName(ahead).distinct(), "entries")
        if (count := now.count()) == n:
            return now.join(places, ["file", "start"]).groupBy("file", "block").agg(F.min("start").alias("entry"))
        n = count
        next_ = jumps.select("file", F.col("start").alias("exit"), F.col("exit").alias("far"))
        jumps = written(jumps.join(next_, ["file", "exit"], "left").select("file", "start", F.coalesce("far", "exit").alias("exit")), "jumps")


def _reached(rows: pa.Table) -> pa.Table:
    """The candidates of a range that its entry's chain visits."""
    starts, succ = rows.column("start").to_pylist(), rows.column("succ").to_pylist()
    row = {s: i for i, s in enumerate(starts)}
    at, kept = rows.column("entry")[0].as_py(), []
    while at in row:
        kept.append(row[at])
        at = succ[row[at]]
    return rows.select(["file", "block", "seq", "start", "succ"]).take(pa.array(kept, pa.int64()))


def _pieced(parts: DataFrame, found: DataFrame, base: DataFrame, open_: DataFrame, payload: bool) -> DataFrame:
    """Records on the chain whose payload holds magic, put together from pieces that are read once more."""
    same = ["file", "block", "seq"]
    spans = open_.select(F.col("file").alias("f"), F.col("start").alias("a"), F.col("succ").alias("b"))
    at = found.select(*same, "rel").join(base, ["file", "block"]).join(spans.select("f").distinct(), F.col("file") == F.col("f"), "left_semi")
    at = at.select(*same, (F.col("base") + F.col("rel") - len(MAGIC)).alias("start"))
    last = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    owned = at.join(spans, (F.col("file") == F.col("f")) & (F.col("start") == F.col("a")), "left")
    owned = owned.select(*same, "start", F.last("a", True).over(last).alias("a"), F.last("b", True).over(last).alias("b")).where("start < b")
    numbered = parts.mapInArrow(_numbered, "file string, block long, seq long, bytes binary")
    schema = "page_id long, url string, type string, digest string, refers_to long, payload_bytes long, bad boolean, payload binary"
    return owned.join(numbered, same).select("file", "a", "start", "bytes").groupBy("file", "a").applyInArrow(lambda t: _together(t, payload), schema)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, seq = None, 0
    for batch in batches:
        numbers = []
        for key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            last, seq = key, seq + 1 if key == last else 0
            numbers.append(seq)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(numbers, pa.int64()), batch.column(0)], names=["file", "block", "seq", "bytes"])


def _together(rows: pa.Table, payload: bool) -> pa.Table:
    rows = rows.sort_by("start")
    whole = MAGIC.encode().join(rows.column("bytes").to_pylist())
    at, size, head = _parsed(whole)
    row = {"page_id": _id(_field(head, b"warc-record-id")), "url": _field(head, b"warc-target-uri").decode(errors="replace"), "type": _field(head, b"warc-type").decode(errors="replace"), "refers_to": _id(_field(head, b"warc-refers-to")), "bad": False}
    row |= _content(whole[at : at + size], head, payload)
    schema = _arrow("page_id long, url string, type string, digest string, refers_to long, payload_bytes long, bad boolean, payload binary")
    return pa.Table.from_pylist([row], schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` written as a record and read back."""
    path = scratch_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB's answer to the same question.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS x FROM p),
d AS (SELECT page_id, n, translate(concat(upper(to_base(('0x' || substr(x, 1, 10))::BIGINT, 32, 8)), upper(to_base(('0x' || substr(x, 11, 10))::BIGINT, 32, 8)),
             upper(to_base(('0x' || substr(x, 21, 10))::BIGINT, 32, 8)), upper(to_base(('0x' || substr(x, 31, 10))::BIGINT, 32, 8))),
             '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest FROM h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, n AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""
