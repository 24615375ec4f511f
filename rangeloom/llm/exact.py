"""Exact dedup by an extendible-hash index on shared files. DataFrame functions only."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, fresh_path, held, materialize, note, scratch, table, unused


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _first() -> Column:
    """Order in which rows of equal text are kept: smallest id, nulls last, then the row's own number."""
    return F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")


def directory(cells: list[tuple[int, int]], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Extendible-hash directory from ``(cell, entries)`` at ``max_depth`` bits.

    Starts with one bucket and doubles: a bucket with more than ``capacity`` entries is split by the
    next bit, others keep their local depth. Returns ``(first_cell, last_cell, bucket)``, ranges of
    the hash in order that cover it. At ``max_depth`` a bucket stays overfull and its file just grows.
    """
    load = [0] * (1 << max_depth)
    for c, n in cells:
        load[c] = n
    upto = [0, *accumulate(load)]
    out, todo = [], [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        lo, hi = prefix << (max_depth - depth), (prefix + 1) << (max_depth - depth)
        if depth < max_depth and upto[hi] - upto[lo] > capacity:
            todo += [(depth + 1, prefix * 2 + 1), (depth + 1, prefix * 2)]
        else:
            out.append((lo, hi - 1, len(out)))
    return out


def _owned(df: DataFrame, n_buckets: int, name: str, *order: str) -> DataFrame:
    """``df`` stored with a file for each bucket, written in ``order`` by the one task that owns it."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)
    note(spark, path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def exact_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", capacity: int = 1 << 16, max_depth: int = 16, hash_bits: int = 64, most: int = 1 << 18) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, bucket``.

    1. Each row becomes an index record ``(hash, id)``. The directory doubles until no bucket holds over ``capacity``
       records. It has 2^``max_depth`` cells at most, whatever the data: that bounds what the driver sees and what
       is broadcast. A bucket of equal hashes can't be split and just grows.
    2. Records of equal hash are merged before the shuffle to one entry, however many copies there are. Each bucket, a
       key range of the hash, is one file in the shared folder, sorted, written by the task that owns it.
    3. A hash met once collides with none. The texts of the others, equal bytes merged before the shuffle, go to
       their bucket's owner, which chains those of one hash and numbers what differs in its bytes.
    4. Rows read their group from the index: by hash where the chain has one text, else by hash and bytes.

    Null text counts as empty. A null id sorts last. Rows that repeat an id and a text count one by
    one and exactly one is kept. An empty table gives no rows; other columns are ignored. Texts may have any length.
    ``hash_bits`` under 64 is for tests that want collisions. Up to ``most`` hashes are broadcast to their joins, more are
    shuffled; the result is the same.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), normalised(F.col(text)).alias("norm"))
    h = F.xxhash64("norm") if hash_bits == 64 else F.shiftleft(F.xxhash64("norm"), 64 - hash_bits)
    cell = F.shiftrightunsigned("h", 64 - max_depth).cast("int")
    rows = rows.withColumn("h", h)
    keys = rows.select("doc_id", "uid", "h", F.unhex(F.sha2("norm", 256)).alias("sha")).withColumn("cell", cell)
    keys = materialize(keys, "exact-keys")

    ranges = directory([tuple(r) for r in keys.groupBy("cell").count().collect()], capacity, max_depth)
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(ranges, "lo int, hi int, bucket int").select(F.explode(F.sequence("lo", "hi")).alias("cell"), "bucket"))
    entries = keys.groupBy("h", "cell").agg(F.count("*").alias("n"), F.min(_first()).alias("first"))
    index = _owned(entries.join(where, "cell").select("bucket", "h", "n", "first"), len(ranges), "exact-index", "h")
    twice = held(index.where("n > 1"), most)

    texts = rows.join(twice.select("h", "bucket"), "h").groupBy("bucket", "h", "norm").agg(F.count("*").alias("n"))
    slot = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("norm"))
    chains = _owned(texts.repartitionById(len(ranges), F.col("bucket")).select("bucket", "h", slot.alias("slot"), "n"), len(ranges), "exact-chains", "h", "slot")
    collided = materialize(chains.where("slot = 2").select("h"), "exact-collided")

    alone = F.col("first").isNull()
    keep = [F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (alone | (F.col("first.uid") == F.col("uid"))).alias("kept")]
    cols = ["doc_id", *keep, F.lower(F.hex("sha")).alias("text_sha256"), "bucket"]
    found = keys.join(where, "cell").join(twice.drop("bucket"), "h", "left")
    if collided.isEmpty():
        return found.select(*cols)
    clear = found.join(collided, "h", "left_anti").select(*cols)
    # Of chains of several texts each row meets its own by the bytes.
    odd = materialize(rows.withColumn("cell", cell).join(collided, "h", "left_semi").join(where, "cell"), "exact-odd")
    slots = odd.groupBy("h", "norm").agg(F.count("*").alias("n"), F.min(_first()).alias("first"))
    chained = odd.join(slots, ["h", "norm"]).withColumn("sha", F.unhex(F.sha2("norm", 256))).select(*cols)
    return clear.union(chained)


def op3_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents")).drop("bucket")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm, row_number() OVER () AS uid FROM documents
), w AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, uid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, uid) = 1 AS kept
  FROM t
)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM w
"""


def keep_first(docs: DataFrame, groups: DataFrame, tables) -> DataFrame:
    """Rows of ``docs`` that ``groups`` keeps, with all columns; only what goes is looked up, so most rows just pass."""
    groups = materialize(groups.select("doc_id", "keep_id", "kept", F.unhex("text_sha256").alias("sha")), "exact-groups")
    names = docs.columns
    i, s, key, sha = unused(docs, "i", "s", "key", "sha")
    same = F.col("doc_id").eqNullSafe(F.col("keep_id"))

    def listed(which) -> DataFrame:
        return tables.keep(materialize(groups.where(~F.col("kept") & which).select(F.col("doc_id").alias(key), F.col("sha").alias(sha)).distinct(), "exact-gone"))

    def met(df, keys, how):
        return df.join(held(keys), F.col(i).eqNullSafe(F.col(key)) & (F.col(s) == F.col(sha)), how)

    gone, again = listed(~same), listed(same)
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), s: F.unhex(F.sha2(normalised(F.col("text")), 256))})
    left = met(rows, gone, "left_anti")
    if again.isEmpty():
        return left.select(*names)
    once = met(left, again, "left_semi").dropDuplicates([i, s]).select(*names)
    return met(left, again, "left_anti").select(*names).union(once)


def exact_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts, one row stays, with all columns of ``docs``; of rows that repeat id and text, any one."""
    with scratch() as tables:
        groups = exact_groups(docs)
        return keep_first(docs, groups, tables)
