"""Suffix-array dedup of long repeated byte strings by a difference cover, dealt out by content.

What has to be sorted is narrowed first, losing nothing. Each window of ``LENGTH`` bytes has an anchor: the
k-gram in it with the least hash, leftmost of equals. That depends on the window's bytes alone, so
equal windows have equal anchors at equal places. Neighbouring windows share an anchor and form a run. A
run whose anchor occurs nowhere else has no repeated window and goes.

The other runs become short strings: bytes left of the anchor, one symbol for the anchor's k-gram (named
by a 128-bit hash of it), bytes right of it; a window is then ``SYMBOLS`` symbols long. Strings are dealt
by anchor, so equal windows meet in one task, and their suffixes are sorted there by the difference-cover
algorithm (mod 3): sort sampled triples, recurse on their names, merge the remaining suffixes, compare
adjacent prefixes. Anchors with many different surroundings are split in two by where the window
lies, part of the surroundings joining the named core, until each fits in a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_bits, discard, materialize, passing, small_batches, table

LENGTH = 400
GRAM = 128
PIECE = 1 << 20
#: Symbols sorted at once, and different strings of one anchor: a group always fits.
CHUNK = 1 << 20
CROWD = 1024

_TABLE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW = np.uint64((1 << 24) - 1)


# --- anchors -------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each k-gram, k a power of two, by doubling."""
    h, n = _TABLE[data], 1
    while n < gram:
        x = h[:-n] * _M1
        x += h[n:]
        x ^= x >> np.uint64(29)
        x *= _M2
        h, n = x, 2 * n
    return h


def runs(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: its hash, its place, and the least and greatest distance of a window's start before it."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    width = length - gram + 1
    for at in range(0, len(data) - length + 1, PIECE):
        part = np.frombuffer(data, np.uint8, min(PIECE + length - 1, len(data) - at), at)
        h = gram_hashes(part, gram)
        n = len(h)
        key = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        key[:n] = (h & ~_LOW) | np.arange(n, dtype=np.uint64)
        grid = key.reshape(-1, width)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        p = (np.minimum(behind[: n - width + 1], ahead[width - 1 : n]) & _LOW).astype(np.int64)
        first = np.nonzero(np.concatenate(([True], p[1:] != p[:-1])))[0]
        last = np.concatenate((first[1:], [len(p)])) - 1
        p = p[first]
        for o, x in zip(out, (h[p], p + at, p - last, p - first), strict=True):
            o.append(x)
    if not out[0]:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(map(np.concatenate, out))


# --- difference cover ----------------------------------------------------------------------------------------------


def suffix_array(s: np.ndarray, depth: int | None = None, covers: int = 1) -> np.ndarray:
    """Suffix array of ``s`` (symbols 1 to 2^21) by the difference cover {1, 2} mod 3.

    Up to 2^21 symbols. With ``depth``, suffixes need be in order by their first ``depth`` symbols only, and
    the recursion ends where names stand for that many (``covers``: symbols for each of ``s``).
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    pad = np.concatenate([s.astype(np.uint64), np.zeros(5, np.uint64)])
    b1, b2 = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # a sample at n itself keeps the halves apart
    b12 = np.concatenate([b1, b2])
    base = np.uint64(21)
    triples = (pad[b12] << (base + base)) | (pad[b12 + 1] << base) | pad[b12 + 2]
    order = np.argsort(triples, kind="stable")
    ranked = triples[order]
    names = np.empty(len(b12), np.int64)
    names[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
    if names[order[-1]] < len(b12) and (depth is None or 3 * covers < depth):
        order = suffix_array(names, depth, 3 * covers)
    rank = np.zeros(n + 5, np.uint64)
    rank[b12[order]] = np.arange(1, len(b12) + 1, dtype=np.uint64)
    sa12 = b12[order]
    sa12 = sa12[sa12 < n]
    b0 = np.arange(0, n, 3)
    key = (pad[b0] << np.uint64(32)) | rank[b0 + 1]
    sa0 = b0[np.argsort(key, kind="stable")]
    # Merge: every suffix goes to its place in its own list plus the number of the other list's that precede it.
    one = sa12 % 3 == 1
    x, y = sa12[one], sa12[~one]
    k1 = lambda i: (pad[i] << np.uint64(32)) | rank[i + 1]
    k2 = lambda i: (pad[i] << np.uint64(43)) | (pad[i + 1] << np.uint64(22)) | rank[i + 2]
    z1, z2 = k1(sa0), k2(sa0)
    ahead = np.empty(len(sa12), np.int64)
    ahead[one] = np.searchsorted(z1, k1(x), side="left")
    ahead[~one] = np.searchsorted(z2, k2(y), side="left")
    out = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    place = np.arange(len(sa12)) + np.maximum.accumulate(ahead) if len(sa12) else ahead
    out[place] = sa12
    taken[place] = True
    out[~taken] = sa0
    return out


def repeated_starts(strings: list[tuple[np.ndarray, int, int]], symbols: int) -> list[np.ndarray]:
    """Which windows of each string also stand in another place of these strings.

    Strings are (symbols, group, windows): a window is ``symbols`` long and windows begin at the first
    ``windows`` places. Equal windows have their group's core symbol, so they are of one group.
    """
    sizes = np.array([len(s) + 1 for s, _, _ in strings])
    at = np.concatenate(([0], np.cumsum(sizes)))
    flat = np.ones(at[-1], np.int64)  # 1 ends a string
    valid = np.zeros(at[-1] + 1, bool)
    for (s, _, w), a in zip(strings, at.tolist(), strict=False):
        flat[a : a + len(s)] = s
        valid[a : a + w] = True
    order = suffix_array(flat, symbols)
    order = order[valid[order]]
    x, y = order[:-1], order[1:]
    live = np.arange(len(x))
    for k in range(0, symbols, 16):  # adjacent prefixes; most pairs part early
        span = np.arange(k, min(k + 16, symbols))
        live = live[(flat[x[live][:, None] + span] == flat[y[live][:, None] + span]).all(axis=1)]
    hit = np.zeros(at[-1], bool)
    hit[x[live]] = hit[y[live]] = True
    return [hit[a : a + w] for (_, _, w), a in zip(strings, at.tolist(), strict=False)]


# --- distribution --------------------------------------------------------------------------------------------------

_UNIT = "root binary, v binary, key binary, off int, span int, lo int, hi int, left binary, right binary, n long"


def _digest(*parts: bytes) -> bytes:
    h = xxhash.xxh3_128()
    for p in parts:
        h.update(len(p).to_bytes(4, "little"))
        h.update(p)
    return h.digest()


def _unit(root, key, off, span, lo, hi, left, right, n):
    v = _digest(key, lo.to_bytes(4, "little"), left, right)
    return (root or v, v, key, off, span, lo, hi, left, right, n)


def split(row: dict) -> list[tuple]:
    """A string of a crowded anchor as one for the windows nearer the anchor and one for those farther: half the surroundings each.

    Windows at most ``mid`` before the core all have the first ``span - mid`` bytes right of it, the others
    the last ``mid + 1`` bytes left of it; these bytes join the core.
    """
    span, lo, hi, left, right = row["span"], row["lo"], row["hi"], row["left"], row["right"]
    mid, out = span // 2, []
    if lo <= mid:
        top = min(hi, mid)
        core = _digest(b"r", row["key"], right[: span - mid])
        out.append(_unit(row["root"], core, row["off"], mid, lo, top, left[len(left) - top :], right[span - mid :], row["n"]))
    if hi > mid:
        low = max(lo, mid + 1)
        core = _digest(b"l", row["key"], left[len(left) - mid - 1 :])
        out.append(_unit(row["root"], core, row["off"] + mid + 1, span - mid - 1, low - mid - 1, hi - mid - 1, left[: len(left) - mid - 1], right[: span - low], row["n"]))
    return out


def _table(rows: list[tuple], schema: pa.Schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.types, strict=True)], schema=schema)


_UNIT_ARROW = pa.schema([("root", pa.binary()), ("v", pa.binary()), ("key", pa.binary()), ("off", pa.int32()), ("span", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.int64())])
_FOUND = pa.schema([("v", pa.binary()), ("near", pa.int32()), ("far", pa.int32())])


def _split_rows(batches):
    for b in batches:
        yield _table([u for row in b.to_pylist() for u in split(row)], _UNIT_ARROW)


def _sort_groups(batches):
    """Streams strings sorted by anchor; sorts the suffixes of whole groups, up to CHUNK symbols at once."""
    held: list[dict] = []
    size = 0

    def work(rows):
        names: dict[bytes, int] = {}
        strings = []
        for r in rows:
            g = names.setdefault(r["key"], len(names))
            s = np.frombuffer(r["left"] + b"\0" + r["right"], np.uint8).astype(np.int64) + 2
            s[len(r["left"])] = 258 + g
            strings.append((s, g, r["hi"] - r["lo"] + 1))
        by_span: dict[int, list[int]] = {}
        for k, r in enumerate(rows):
            by_span.setdefault(r["span"], []).append(k)
        out = []
        for span, ks in by_span.items():
            for k, hit in zip(ks, repeated_starts([strings[k] for k in ks], span + 1), strict=True):
                r = rows[k]
                edge = np.nonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))[0].reshape(-1, 2)
                for a, b in edge.tolist():
                    out.append((r["v"], r["off"] + r["hi"] - b + 1, r["off"] + r["hi"] - a))
        return _table(out, _FOUND)

    for b in batches:
        for r in b.to_pylist():
            n = len(r["left"]) + len(r["right"]) + 2
            if size + n > CHUNK and r["key"] != held[-1]["key"]:
                yield work(held)
                held, size = [], 0
            held.append(r)
            size += n
    if held:
        yield work(held)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """``(rows, spans)``: per row ``id, uid, n_bytes``, and per distinct text ``uid`` the maximal removed spans.

    ``uid`` is the SHA-256 of the text. ``spans`` is an array of ``start, end``, byte offsets. Texts that occur twice are
    repeated from end to end and appear in ``rows`` with ``copies`` over 1; ``spans`` may then hold less.
    """
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two, at most length")
    small_batches(docs.sparkSession)
    span0 = length - gram
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(data.alias("data")).withColumn("uid", F.unhex(F.sha2("data", 256))).where(F.octet_length("data") >= length)

    def find(batches):
        seen: set[bytes] = set()
        for b in batches:
            for uid, t in zip(b.column("uid").to_pylist(), b.column("data"), strict=True):
                if uid in seen:  # a text again in this task: copies are told by their count
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(uid)
                h, p, lo, hi = runs(t.as_py(), length, gram)
                for k in range(0, len(h), 1 << 16):
                    m = min(1 << 16, len(h) - k)
                    s = slice(k, k + m)
                    yield pa.RecordBatch.from_arrays([pa.array([uid] * m, pa.binary()), pa.array(h[s].view(np.int64)), pa.array(p[s]), pa.array(lo[s].astype(np.int32)), pa.array(hi[s].astype(np.int32))], ["uid", "h", "p", "lo", "hi"])

    every = materialize(base.mapInArrow(find, "uid binary, h long, p long, lo int, hi int"), "suffix-runs")
    # A table of its own, so that the join below deals a very common anchor to several tasks.
    shared = materialize(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-shared")
    where = materialize(every.join(shared, "h", "left_semi").groupBy("uid").agg(F.collect_set(F.struct("p", "lo", "hi")).alias("runs")), "suffix-where")
    discard(every)

    box = docs.sparkSession.sparkContext.broadcast(bloom(where.select("uid")))
    hashed = base.withColumns(bloom_bits())
    texts = passing(hashed, box).select("uid", "data").join(where, "uid")

    def cut(batches):
        """Occurrences, and each different string once in a task."""
        kept: set[bytes] = set()
        names = ["uid", "p", "v", "key", "lo", "hi", "left", "right"]
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        seen: set[bytes] = set()
        out: list[tuple] = []
        for b in batches:
            for uid, t, found in zip(b.column("uid").to_pylist(), b.column("data"), b.column("runs"), strict=True):
                if uid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(uid)
                t = t.as_py()
                for r in found.as_py():
                    p, lo, hi = r["p"], r["lo"], r["hi"]
                    key = xxhash.xxh3_128_digest(t[p : p + gram])
                    left, right = t[p - hi : p], t[p + gram : p + length - lo]
                    v = _digest(key, lo.to_bytes(4, "little"), left, right)
                    if v in kept:
                        out.append((uid, p, v, None, None, None, None, None))
                    else:
                        if len(kept) > 100_000:
                            kept.clear()
                        kept.add(v)
                        out.append((uid, p, v, key, lo, hi, left, right))
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    cuts = materialize(texts.mapInArrow(cut, "uid binary, p long, v binary, key binary, lo int, hi int, left binary, right binary"), "suffix-cuts")
    # The same text may be read by two tasks: its occurrences count once.
    occurs = materialize(cuts.select("uid", "p", "v").distinct(), "suffix-occurs")
    strings = cuts.where("key is not null").select("v", "key", "lo", "hi", "left", "right").distinct()
    strings = strings.join(occurs.groupBy("v").agg(F.count("*").alias("n")), "v")
    todo = materialize(strings.select(F.col("v").alias("root"), "v", "key", F.lit(0).alias("off"), F.lit(span0).alias("span"), "lo", "hi", "left", "right", "n"), "suffix-units")
    discard(cuts)

    ready = []
    while True:
        many = materialize(todo.groupBy("key").agg(F.count_distinct("v").alias("m"), F.max("span").alias("s")).where(f"m > {crowd} and s > 0").select("key"), "suffix-crowded")
        if many.isEmpty():
            ready.append(todo)
            break
        ready.append(materialize(todo.join(many, "key", "left_anti").select(*todo.columns), "suffix-ready"))
        todo = materialize(todo.join(many, "key", "left_semi").select(*todo.columns).mapInArrow(_split_rows, _UNIT), "suffix-split")
    units = ready[0]
    for r in ready[1:]:
        units = units.union(r)

    distinct = units.groupBy("v", "key", "off", "span", "lo", "hi", "left", "right").agg(F.sum("n").alias("n"))
    distinct = materialize(distinct, "suffix-distinct")
    company = distinct.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    alone = distinct.where("n > 1").select("v", (F.col("off") + F.col("lo")).alias("near"), (F.col("off") + F.col("hi")).alias("far"))
    group = distinct.join(company, "key", "left_semi").select("v", "key", "off", "span", "lo", "hi", "left", "right")
    group = group.repartition("key").sortWithinPartitions("key", "v").mapInArrow(_sort_groups, "v binary, near int, far int")
    found = materialize(group.union(alone), "suffix-found")
    found = found.join(units.select("v", "root"), "v").select(F.col("root").alias("v"), "near", "far")
    at = occurs.join(found, "v").select("uid", (F.col("p") - F.col("far")).alias("start"), (F.col("p") - F.col("near") + length).alias("end"))
    spans = at.groupBy("uid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return base, materialize(spans, "suffix-spans")


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open intervals as maximal runs; those that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def dedup_repeats(docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256``.

    Bytes (UTF-8; null: none) covered by a string of ``length`` bytes that also starts elsewhere are removed; ``spans``
    are the removed runs and ``kept`` is the rest, null if nothing is removed. Texts shorter than
    ``length`` keep all. Repeated rows count as copies of each other.
    """
    base, spans = repeated_spans(docs, text, length, gram, crowd)
    box = docs.sparkSession.sparkContext.broadcast(bloom(spans.select("uid")))
    texts = passing(base.withColumns(bloom_bits()), box).select("uid", "data").join(spans, "uid")

    def clean(batches):
        seen: set[bytes] = set()
        for b in batches:
            rows = []
            for uid, t, found in zip(b.column("uid").to_pylist(), b.column("data"), b.column("spans"), strict=True):
                if uid in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(uid)
                t, at, kept = t.as_py(), 0, []
                runs_ = merge([(s["start"], s["end"]) for s in found.as_py()])
                for x, y in runs_:
                    kept.append(t[at:x])
                    at = y
                kept.append(t[at:])
                kept = b"".join(kept)
                rows.append((uid, len(t) - len(kept), len(runs_), [{"start": x, "end": y} for x, y in runs_], kept, hashlib.sha256(kept).hexdigest()))
            yield _table(rows, _CLEAN)

    done = texts.mapInArrow(clean, "uid binary, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string")
    done = materialize(done.dropDuplicates(["uid"]), "suffix-clean").withColumnRenamed("uid", "_uid")
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(data).cast("long").alias("n_bytes"), F.unhex(F.sha2(data, 256)).alias("uid"))
    rows = materialize(rows, "suffix-rows")
    copies = materialize(rows.groupBy("uid").agg(F.count("*").alias("copies")).where("copies > 1").select(F.col("uid").alias("_copy")), "suffix-copies")
    met = rows.join(done, rows.uid == done._uid, "left").join(copies, rows.uid == copies._copy, "left")
    whole = F.col("_copy").isNotNull() & (F.col("n_bytes") >= length)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return met.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, one).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
        F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
        F.when(whole, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("uid")))).alias("kept_sha256"),
    )


_CLEAN = pa.schema([("uid", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()), ("kept_sha256", pa.string())])


def op9_suffix_dedup(spark, sf_dir):
    return dedup_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
