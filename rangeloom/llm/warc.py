"""WARC archives and their Merkle fixity audit.

Records are laid out in shards of about ``SHARD_BYTES``: a record's digest names its shard and its place in
the shard, so the layout needs no global order and the same rows always give the same archive. The
manifest (digest, shard, offset) is one replica's tree; what is stored, read back, is the other's.
Nodes hash FANOUT ordered children each; only below nodes that differ is anything compared again.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, shared_dir, table

SHARD_BYTES = 16 << 20
FANOUT_BITS = 4
END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"


def record_text(record_id: Column, url: Column, payload: Column, date: str = DATE) -> Column:
    """A WARC/1.1 resource record without the blank lines that end it. Null parts count as empty."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\r\n]+", " ")
    payload = F.coalesce(payload, F.lit(""))
    lines = [
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"), payload,
    ]
    return F.concat(*lines)


def records(pages: DataFrame, html: str = "html", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, record, length, sha256``; length and digest include the record's end."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), record_text(F.col(id_col), F.col(url), F.col(html)).alias("record"))
    return rows.withColumns({"length": F.octet_length("record").cast("long") + len(END), "sha256": F.sha2(F.concat("record", F.lit(END)), 256)})


def _shard(shards: int) -> Column:
    return (F.conv(F.substring("sha256", 1, 8), 16, 10).cast("long") % shards).cast("int")


def manifest(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``page_id, url, shard, seq, offset, length, sha256`` of each record; rows that repeat a record entirely share its digest."""
    thin = materialize(rows.select("page_id", "url", "length", "sha256"), "warc-records")
    shards = max(1, -(-(thin.agg(F.sum("length")).first()[0] or 0) // shard_bytes))
    order = Window.partitionBy("shard").orderBy("sha256")
    seq, ahead = F.row_number().over(order) - 1, F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = thin.withColumn("shard", _shard(shards)).withColumns({"seq": seq.cast("long"), "offset": F.coalesce(ahead, F.lit(0)).cast("long")})
    out = materialize(out, "warc-manifest")
    out._shards = shards
    return out


def write_warc(rows: DataFrame, path: str, shards: int, text: str = "record") -> None:
    """Archive of ``records`` at ``path/shard=N``, one compressed file for a shard, in order of the digests."""
    rows = rows.select(_shard(shards).alias("shard"), "sha256", F.col(text).alias("value"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "sha256").select("shard", "value")
    rows.write.partitionBy("shard").option("lineSep", END).option("compression", "gzip").text(path)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)", re.I)


def split_records(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each record. Where framing is broken, the rest is one range."""
    out, at, n = [], 0, len(data)
    while at < n:
        head = data.find(b"\r\n\r\n", at)
        m = _LENGTH.search(data, at, head) if head >= 0 else None
        end = head + 4 + int(m[1]) + len(END) if m else n + 1
        if end > n or data[end - len(END) : end] != END.encode():
            end = n
        out.append((at, end - at))
        at = end
    return out


def _unzip(data: bytes) -> bytes:
    """As much as can be read; what follows damage to the compressed stream is missing, and so found."""
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error):
        z, out = zlib.decompressobj(47), b""
        try:
            for k in range(0, len(data), 4096):
                out += z.decompress(data[k : k + 4096])
        except zlib.error:
            pass
        return out


def _stored(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("int").alias("shard"), "content")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``shard, seq, offset, record`` (bytes, with the record's end) of an archive; a file is read by one task and holds one shard."""

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                data = _unzip(data.as_py())
                spans = split_records(data)
                for k in range(0, len(spans), 256):
                    part = spans[k : k + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * len(part), pa.int32()), pa.array(range(k, k + len(part)), pa.int64()), pa.array([o for o, _ in part], pa.int64()), pa.array([data[o : o + n] for o, n in part], pa.binary())], ["shard", "seq", "offset", "record"])

    return _stored(spark, path).mapInArrow(run, "shard int, seq long, offset long, record binary")


def stored_leaves(spark: SparkSession, path: str) -> DataFrame:
    """``shard, seq, offset, length, sha256`` of what is stored."""

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("content"), strict=True):
                data = memoryview(_unzip(data.as_py()))
                spans = split_records(bytes(data))
                digests = [hashlib.sha256(data[o : o + n]).hexdigest() for o, n in spans]
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(spans), pa.int32()), pa.array(range(len(spans)), pa.int64()), pa.array([o for o, _ in spans], pa.int64()), pa.array([n for _, n in spans], pa.int64()), pa.array(digests, pa.string())], ["shard", "seq", "offset", "length", "sha256"])

    return _stored(spark, path).mapInArrow(run, "shard int, seq long, offset long, length long, sha256 string")


def merkle_levels(leaves: DataFrame, top: int) -> list[DataFrame]:
    """Level 0 to ``top``: ``shard, node, lo, hi, hash``; a node stands for the bytes from lo up to hi of its shard."""
    cols = ["shard", F.col("seq").alias("node"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"), F.col("sha256").alias("hash")]
    out = [materialize(leaves.select(*cols), "merkle-0")]
    for k in range(1, top + 1):
        kids = F.array_sort(F.collect_list(F.struct("node", "lo", "hi", "hash")))  # FANOUT at most
        up = out[-1].groupBy("shard", F.shiftright("node", FANOUT_BITS).alias("up")).agg(kids.alias("kids"))
        up = up.select("shard", F.col("up").alias("node"), F.col("kids")[0]["lo"].alias("lo"), F.expr("kids[size(kids) - 1].hi").alias("hi"), F.sha2(F.array_join(F.transform("kids", lambda x: F.concat_ws(":", x["lo"], x["hi"], x["hash"])), ","), 256).alias("hash"))
        out.append(materialize(up, f"merkle-{k}"))
    return out


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Leaves (``shard, node, lo, hi, hash, stored_hash``) at which two replicas differ; null where one has no such leaf."""
    deepest = max(x.agg(F.max("seq")).first()[0] or 0 for x in (a, b))
    top = max(1, -(-max(1, int(deepest).bit_length()) // FANOUT_BITS))
    left, right = merkle_levels(a, top), merkle_levels(b, top)
    bad = None
    for k in range(top, -1, -1):
        x, y = left[k], right[k].select("shard", "node", F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.col("hash").alias("stored_hash"))
        if bad is not None:
            below = bad.select("shard", F.col("node").alias("up"))
            x, y = (z.withColumn("up", F.shiftright("node", FANOUT_BITS)).join(below, ["shard", "up"], "left_semi").drop("up") for z in (x, y))
        met = x.join(y, ["shard", "node"], "full_outer")
        same = F.col("hash").eqNullSafe(F.col("stored_hash")) & F.col("lo").eqNullSafe(F.col("lo_b")) & F.col("hi").eqNullSafe(F.col("hi_b"))
        bad = materialize(met.where(~same).select("shard", "node", "lo", "hi", "hash", "stored_hash"), "merkle-bad")
    return bad


def op8_warc_fixity(spark, sf_dir):
    """Archives all pages, with a flipped byte in each record whose digest begins with 00, and audits what is stored.

    One row per page: ``page_id, shard, offset, length, sha256, corrupt, stored_sha256`` (null unless the audit came to it).
    """
    rows = records(table(spark, sf_dir, "pages"))
    plan = manifest(rows)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    rotten = F.regexp_replace("record", "^([^\n]*\n[^\n]*\n[^\n]*\n[^\n]*\n[^\n]*\nContent-Type: text/htm)l", "$1k")
    write_warc(rows.withColumn("stored", F.when(F.col("sha256").startswith("00"), rotten).otherwise(F.col("record"))), path, plan._shards, "stored")
    bad = audit(plan, stored_leaves(spark, path)).select("shard", F.col("node").alias("seq"), "stored_hash", F.lit(True).alias("found"))
    met = plan.join(bad, ["shard", "seq"], "left")
    return met.select("page_id", "shard", "offset", "length", "sha256", F.coalesce("found", F.lit(False)).alias("corrupt"), F.col("stored_hash").alias("stored_sha256"))


OP8_SQL = f"""
WITH r AS (
  SELECT page_id, 'WARC/1.1' || e || 'WARC-Type: resource' || e || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || e ||
    'WARC-Target-URI: ' || regexp_replace(coalesce(url, ''), '[\\r\\n]+', ' ', 'g') || e || 'WARC-Date: {DATE}' || e || 'Content-Type: text/htm' AS head,
    e || 'Content-Length: ' || strlen(coalesce(html, '')) || e || e || coalesce(html, '') || e || e AS tail
  FROM pages, (SELECT chr(13) || chr(10) AS e)
), s AS (
  SELECT page_id, strlen(head) + 1 + strlen(tail) AS length, sha256(head || 'l' || tail) AS sha256, sha256(head || 'k' || tail) AS rotten FROM r
), n AS (
  SELECT *, CAST(('0x' || substr(sha256, 1, 8))::BIGINT % greatest(1, ((SELECT sum(length) FROM s) + {SHARD_BYTES - 1})::BIGINT // {SHARD_BYTES}) AS INTEGER) AS shard FROM s
)
SELECT page_id, shard, coalesce(sum(length) OVER (PARTITION BY shard ORDER BY sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
  length, sha256, starts_with(sha256, '00') AS corrupt, CASE WHEN starts_with(sha256, '00') THEN rotten END AS stored_sha256
FROM n
"""
