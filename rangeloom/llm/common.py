"""Shared plumbing: tables in the cluster's shared folder, components, hash rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..names import unused  # noqa: F401
from ..storage import delete, fresh_path, materialize, note, scratch, shared_dir  # noqa: F401

#: ASCII white space and its complement, as the operators' contracts name them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Texts can be long: Arrow batches of ``rows`` rows and ``size`` bytes or so, unless the session already asks for less."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            if not 0 < int(spark.conf.get(key).removesuffix("b")) <= most:
                spark.conf.set(key, str(most))
        except ValueError:  # a size with a unit is the user's own
            pass


def give_back() -> None:
    """What Python has freed goes back to the system, where it can: a driver or worker that lives on then holds less."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """``run`` over a task's batches; what it has freed goes back at the task's end."""

    def to_the_end(batches):
        yield from run(batches)
        give_back()

    return to_the_end


def spread(df: DataFrame) -> DataFrame:
    """A small table in as many partitions as shuffles have, before rows multiply."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def held(keys: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """A stored table of narrow rows, to be broadcast to its join if it has at most ``rows`` of them, else shuffled."""
    return F.broadcast(keys) if keys.count() <= rows else keys


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame that ``materialize`` made."""
    if path := getattr(df, "_stored_at", None):
        delete(df.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def fold_of(doc_id: int | None, parts: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts


BLOOM_BITS = 26


def bloom_bits(column: str = "uid") -> dict[str, Column]:
    """Columns ``b0`` and ``b1``: a key's places in the filter."""
    return {f"b{k}": F.pmod(F.xxhash64(column, F.lit(k)), F.lit(1 << BLOOM_BITS)) for k in range(2)}


def bloom(keys: DataFrame, column: str = "uid") -> np.ndarray:
    """Filter of fixed size (8 MB) over a column of keys: it only spares a shuffle, a join decides."""
    bits = keys.select(F.explode(F.array(*bloom_bits(column).values())).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 5).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits"))
    out = np.zeros(1 << (BLOOM_BITS - 5), np.uint32)
    for part in words.toArrow().to_batches():
        out[part.column("word").to_numpy()] = part.column("bits").to_numpy().astype(np.uint32)
    return out


def in_bloom(b: pa.RecordBatch, bits: np.ndarray) -> np.ndarray:
    """Whether the places ``b0`` and ``b1`` of each row are in the filter."""
    ok = np.ones(b.num_rows, bool)
    for c in ("b0", "b1"):
        bit = b.column(c).to_numpy()
        ok &= (bits[bit >> 5] >> (bit & 31).astype(np.uint32) & 1).astype(bool)
    return ok


def passing(rows: DataFrame, box) -> DataFrame:
    """Rows whose ``b0`` and ``b1`` are in the broadcast filter, without these two columns."""
    kept = [c for c in rows.columns if c not in ("b0", "b1")]

    def run(batches):
        for b in batches:
            yield b.select(kept).filter(pa.array(in_bloom(b, box.value), pa.bool_()))

    return rows.mapInArrow(run, rows.select(*kept).schema)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node that has an edge: ``(node, root)``.

    ``edges`` has longs ``a`` and ``b``, in any direction, repeats allowed. Alternates large-star and
    small-star steps; each halves the depth of the trees. Minima are aggregated before the shuffle,
    so the neighbours of a hub are never gathered in one place. Each round is a table in the
    shared folder; the two before it are deleted.
    """
    spark = edges.sparkSession

    def star(df: DataFrame, large: bool) -> DataFrame:
        if large:
            both = df.select("a", "b").union(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        met = both.join(least, "a")
        if large:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(met.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    was = mark(now)
    for _ in range(max_rounds):
        if not was[0]:
            break
        after = materialize(star(star(now, True), False), "cc")
        seen = mark(after)
        discard(now)
        now, done, was = after, seen == was, seen
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
