"""SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits and links at ``radius`` 3 or fewer differing bits. The word is cut in two
halves of 32 bits, so a linked pair differs in at most one bit of some half: the threshold inside a
half is t = 1. Each half is covered by a code: the perfect Hamming code [31, 26], covering radius R = 1,
on 31 bits, times the one remaining bit as it is. Codewords are the anchors, 2^27 for each half.

A fingerprint x is at home at its nearest anchor, within R. A y that links with x is then within
R + t = 2 of that anchor, so each fingerprint visits every anchor within R + t (17 or so for a half)
and pairs are compared at home anchors only. No pair is lost and two random fingerprints meet
with probability 2^-22 for each half.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bloom, bloom_bits, connected_components, give_back, held, in_bloom, lean, materialize, scratch, small_batches, spread, table, unused

SEED = 42
BLOCK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of a whole text (UTF-8): A-Z lower-cased, words parted by ASCII white space, repeats counted."""
    words = (text or b"").lower().split()  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return 0
    h, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= shingle:
        return h(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    n, ends = len(starts), ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = [h(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(part, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


# --- the covering code ---------------------------------------------------------------------------------------------

#: Syndrome of single bits of the Hamming code: bit i (0..30) has syndrome i + 1.
_COLUMNS = np.arange(1, 32, dtype=np.int64)


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros_like(x)
    for i in range(31):
        s ^= np.where((x >> i) & 1, i + 1, 0)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 32-bit halves: their home anchor, and all anchors within R + t, one row each; -1 is no anchor.

    Columns: the home; the home with the free bit flipped; the codewords at distance 2.
    A codeword itself (syndrome 0) has no codeword at distance 1 or 2 but its own.
    """
    coded, free = half & 0x7FFFFFFF, half & 0x80000000
    s = _syndrome(coded)
    near = np.where(s > 0, coded ^ (1 << np.maximum(s - 1, 0)), coded)
    home = near | free
    out = [home, home ^ 0x80000000]
    # Pairs of bits i < j whose syndromes add up to s: i + 1 = a, j + 1 = a ^ s. From s > 0 only.
    for a in range(1, 32):
        b = a ^ s
        hit = (s > 0) & (b > a)
        out.append(np.where(hit, (coded ^ (1 << (a - 1)) ^ (1 << np.maximum(b - 1, 0))) | free, -1))
    return home, np.stack(out, axis=1)


def _visits(columns: list[str], homes: bool):
    """(anchor, node) of each row, for both halves of each fingerprint column: home anchors, or all others in reach.

    The anchor's high bits name the half.
    """

    def run(batches):
        for b in batches:
            node = b.column("node").to_numpy(zero_copy_only=False)
            for n, c in enumerate(columns):
                fp = b.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
                for k in (0, 1):
                    home, every = anchors((fp >> np.uint64(32 * k)).astype(np.int64) & 0xFFFFFFFF)
                    every = home[:, None] if homes else np.where(every == home[:, None], -1, every)
                    rows, cols = np.nonzero(every >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(every[rows, cols] | ((2 * n + k) << 33)), pa.array(node[rows])], ["anchor", "node"])

    return run


def _forest(radius: int):
    """For each anchor (and slice of its homes): links that keep together what the slice's pairs link.

    Homes and visitors are compared in blocks; of the pairs found only those that join two trees are
    given out, so a crowd of near copies costs a link for each member, not for each pair.
    """

    def run(key, rows):
        node, at = np.unique(rows.column("node").to_numpy(), return_index=True)
        fp = rows.column("check").to_numpy().view(np.uint64)[at]
        own = np.searchsorted(node, np.unique(rows.column("node").to_numpy()[rows.column("home").to_numpy(zero_copy_only=False)]))
        tree = np.arange(len(node))
        a, b = [], []
        step = max(1, BLOCK // max(1, len(node)))
        far = lambda part: np.bitwise_count(fp[part][:, None] ^ fp[None, :])
        for k in range(0, len(own), step):
            part = own[k : k + step]
            d = far(part).astype(np.int64)
            d[np.arange(len(part)), part] = 1 << 20
            near = d <= radius
            i, j = np.nonzero(near)
            i = part[i]
            while (apart := tree[i] != tree[j]).any():
                i, j = i[apart], j[apart]
                # One link for each tree on the left, then all labels at once; a chain of joins takes a few rounds.
                _, first = np.unique(tree[i], return_index=True)
                for x, y in zip(i[first].tolist(), j[first].tolist(), strict=True):
                    p, q = tree[x], tree[y]
                    if p != q:
                        tree[tree == p] = q
                        a.append(x)
                        b.append(y)
        return pa.table({"a": node[np.array(a, np.int64)], "b": node[np.array(b, np.int64)]})

    return run


def links(fps: DataFrame, radius: int = 3, small: int = 256, slice_size: int = 2048) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints that span the classes of ``radius`` or fewer differing bits."""
    if radius != 3:
        raise ValueError("the halves' threshold is worked out for a radius of 3")
    return _met(fps.select(F.col("fp").alias("node"), "fp"), ["fp"], "fp", radius, small, slice_size)


def _met(prints: DataFrame, columns: list[str], check: str, radius: int, small: int, slice_size: int) -> DataFrame:
    """Pairs of nodes that meet at an anchor, at home for one of them, with checks at most ``radius`` bits apart.

    Homes are counted first; the join with these counts is the one shuffle of all visits, and those to an
    anchor without a home end there, as most do. Where homes times members is up to ``small``, the pairs
    are compared in the join itself. Crowded anchors are dealt in slices of ``slice_size`` homes, each
    with all visitors, to several tasks that give out a forest.
    """
    prints = spread(prints)
    homes = materialize(prints.mapInArrow(_visits(columns, True), "anchor long, node long"), "simhash-homes")
    counts = materialize(homes.groupBy("anchor").agg(F.count("*").alias("homes")), "simhash-counts")  # a table, so that a crowded anchor's join can be dealt to several tasks
    guests = prints.mapInArrow(_visits(columns, False), "anchor long, node long").join(counts, "anchor")
    guests = materialize(guests.select("anchor", "node"), "simhash-guests")
    rows = homes.withColumn("home", F.lit(True)).union(guests.withColumn("home", F.lit(False)))
    members = rows.groupBy("anchor").agg(F.count("*").alias("members"), F.count_if("home").alias("homes")).where("members > 1")
    rows = rows.join(materialize(members, "simhash-members"), "anchor").join(prints.select("node", F.col(check).alias("check")), "node")
    rows = materialize(rows, "simhash-met")
    few = rows.where(F.col("homes") * F.col("members") <= small)
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= radius
    at_home = few.where("home").select("anchor", F.col("node").alias("a"), F.col("check").alias("x"))
    pairs = at_home.join(few.select("anchor", F.col("node").alias("b"), F.col("check").alias("y")), "anchor").where(near & F.expr("a <> b")).select("a", "b")

    crowd = rows.where(F.col("homes") * F.col("members") > small)
    n = F.ceil(F.col("homes") / slice_size).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    crowd = crowd.select("anchor", "node", "check", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), n - 1)).alias("slice"))
    crowd = crowd.select("anchor", "slice", "node", "check", (F.col("home") & (F.col("own") == F.col("slice"))).alias("home"))
    return pairs.union(crowd.groupBy("anchor", "slice").applyInArrow(_forest(radius), "a long, b long"))


def near_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fp, component_id``.

    Equal fingerprints are merged before anything is compared, so copies cost nothing more. A null text
    counts as empty (fingerprint zero). A null id is in the group of its fingerprint but never names it,
    unless no other id does: then ``component_id`` is null. Repeated rows come out as often as they came in.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = materialize(rows.mapInArrow(_fingerprints(shingle), "doc_id long, fp long"), "simhash-prints")
    firsts = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    trees = connected_components(links(firsts, radius))
    named = firsts.join(trees, firsts.fp == trees.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "simhash-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = materialize(named.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir):
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# --- groups by verified similarity -----------------------------------------------------------------------------------

#: Texts from which common shingles are learned, and the most of these that are kept. They set costs, never results.
SAMPLE = 20_000
COMMON = 1 << 18
#: Members of a shingle that are held at once.
CHUNK = 4096
#: Bits of a set's parity sketch.
SKETCH = 1024
#: Room for rounding in bounds on similarity.
EPS = 1e-6


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Hashes of the distinct word n-grams; of a shorter text the whole sequence, of an empty one none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    grams = {b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}
    return np.sort(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64).view(np.int64))


def prefix_size(n: int, similarity: float) -> int:
    """Two sets of ``similarity`` or more share a member among the first ``prefix_size`` of each, in any one order of all members."""
    return max(0, min(n, n - math.ceil(similarity * n - EPS) + 1))


def sketch(grams: np.ndarray) -> bytes:
    """For each of SKETCH cells, whether an odd number of members falls there: two sketches differ in no more bits than the sets have members apart."""
    cells = np.bincount(grams.view(np.uint64) >> np.uint64(64 - SKETCH.bit_length() + 1), minlength=SKETCH)
    return np.packbits(cells & 1).tobytes()


def _common(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that occur in two or more texts of a bounded sample, sorted, and in how many.

    They travel as arrays, one for each task and share of the hash, and are counted by sorting these.
    """
    rate = max(1, rows.count() // SAMPLE)
    parts = 64

    def dealt(batches):
        for b in batches:
            grams = np.sort(np.concatenate([np.zeros(0, np.int64), *(shingles(t.as_py(), shingle) for t in b.column("text").cast(pa.binary()))]))
            cuts = np.searchsorted(grams >> 58, np.arange(-parts // 2, parts // 2 + 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array([grams[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["part", "grams"])

    def counted(batches):
        held = [np.frombuffer(x, np.int64) for b in batches for x in b.column("grams").to_pylist()]
        keys, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys[n > 1]), pa.array(n[n > 1])], ["shingle", "n"])

    some = rows.where(F.pmod(F.xxhash64("uid"), F.lit(rate)) == 0).select("text").mapInArrow(lean(dealt), "part long, grams binary")
    found = some.repartition(parts, "part").mapInArrow(lean(counted), "shingle long, n long").orderBy(F.desc("n"), "shingle").limit(COMMON).toArrow()
    keys, n = found.column("shingle").to_numpy(), found.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int32)
    del found
    give_back()
    return keys, n


def _prefixes(shingle: int, similarity: float, hot: int, box):
    """Of each text: the hash of its shingle set, its SimHash fingerprint, the set's size, sketch and prefix, rare shingles first, and how much of the prefix is before the hot ones."""

    def run(batches):
        common, n = box.value
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                nodes, prints, sizes, cold, firsts, bits = [], [], [], [], [], []
                for t in part.column("text").cast(pa.binary()):
                    grams = shingles(t.as_py(), shingle)
                    prints.append(fingerprint(t.as_py()))
                    nodes.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                    sizes.append(len(grams))
                    bits.append(sketch(grams))
                    known = np.zeros(len(grams), np.int64)
                    if len(common):
                        k = np.minimum(np.searchsorted(common, grams), len(common) - 1)
                        known = np.where(common[k] == grams, n[k], 0)
                    order = np.argsort(known, kind="stable")[: prefix_size(len(grams), similarity)]
                    firsts.append(grams[order])
                    cold.append(int((known[order] < hot).sum()))
                cols = [part.column("doc_id"), part.column("uid"), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(sizes, pa.int32()), pa.array(cold, pa.int32()), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "uid", "node", "fp", "size", "cold", "bits", "prefix"])

    return run


def _possible(size_a, rest_a, size_b, rest_b, similarity: float):
    """Whether sets of these sizes can reach the similarity if they share nothing before a shingle from which on ``rest`` members are left. Numpy or columns."""
    low, high = (F.least, F.greatest) if isinstance(size_a, Column) else (np.minimum, np.maximum)
    return (low(size_a, size_b) >= similarity * high(size_a, size_b) - EPS) & (low(rest_a, rest_b) >= similarity / (1 + similarity) * (size_a + size_b) - EPS)


def _candidates(similarity: float, per_member: int):
    """From rows sorted by shingle and node: a shingle's pairs that its members' sizes and places allow, up to ``per_member`` for each member, or else its rows.

    Pairs are ``(null, a, b, 0, 0)``; rows of a crowd are ``(shingle, node, null, size, rest)``, those that no other member allows left out.
    """
    columns = ["shingle", "a", "b", "size", "rest"]

    def pairs(a, b):
        a, b = np.minimum(a, b), np.maximum(a, b)
        zero = pa.array(np.zeros(len(a), np.int32))
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), zero, zero], columns)

    def rows(s, node, size, rest):
        return pa.RecordBatch.from_arrays([pa.array(s), pa.array(node), pa.nulls(len(s), pa.int64()), pa.array(size), pa.array(rest)], columns)

    def many(s, node, size, rest):
        """One shingle of many members, a block of them at a time."""
        a, b, seen, n, m = [], [], np.zeros(len(node), bool), 0, len(node)
        step = max(1, (1 << 20) // m)
        for k in range(0, m, step):
            i, j = np.nonzero(_possible(size[k : k + step, None], rest[k : k + step, None], size[None, :], rest[None, :], similarity))
            i += k
            i, j = i[i < j], j[i < j]
            seen[i] = seen[j] = True
            n += len(i)
            if n <= per_member * m:
                a.append(node[i])
                b.append(node[j])
        if n <= per_member * m:
            return pairs(np.concatenate(a), np.concatenate(b))
        return rows(s[seen], node[seen], size[seen], rest[seen])

    def lists(s, node, size, rest):
        """Whole shingles."""
        new = np.concatenate(([True], (s[1:] != s[:-1]) | (node[1:] != node[:-1])))
        s, node, size, rest = s[new], node[new], size[new], rest[new]
        at = np.nonzero(np.concatenate(([True], s[1:] != s[:-1])))[0]
        sizes = np.diff(np.append(at, len(s)))
        for m in np.unique(sizes[sizes > 1]).tolist():
            which = at[sizes == m]
            if m > 2 * per_member + 1:  # fewer can't give more than that
                for k in which.tolist():
                    yield many(*(c[k : k + m] for c in (s, node, size, rest)))
                continue
            block = which[:, None] + np.arange(m)[None, :]
            i, j = np.triu_indices(m, 1)
            x, y = block[:, i], block[:, j]
            ok = _possible(size[x], rest[x], size[y], rest[y], similarity)
            yield pairs(node[x[ok]], node[y[ok]])

    def run(batches):
        held, crowd = None, None
        for b in batches:
            if not b.num_rows:
                continue
            got = [b.column(c).to_numpy() for c in ("shingle", "node", "size", "rest")]
            held = got if held is None else [np.concatenate(c) for c in zip(held, got, strict=True)]
            s = held[0]
            cut = int(np.searchsorted(s, s[-1]))
            if cut:
                start = 0
                if crowd is not None:  # the end of a shingle that was too long to hold
                    start = int(np.searchsorted(s, crowd, side="right"))
                    yield rows(*(c[:start] for c in held))
                    crowd = None
                if cut > start:
                    yield from lists(*(c[start:cut] for c in held))
                held = [c[cut:] for c in held]
            if len(held[0]) > CHUNK:
                crowd = int(held[0][0])
                yield rows(*held)
                held = [c[:0] for c in held]
        if held is not None and len(held[0]):
            yield from [rows(*held)] if crowd == int(held[0][0]) else lists(*held)

    return run


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """SimHash candidates ``(a, b)`` among rows of ``node, fp``: each node with the first of its fingerprint, and the first nodes of fingerprints that ``links`` joins."""
    firsts = materialize(nodes.groupBy("fp").agg(F.min("node").alias("first")), "similar-fingerprints")
    same = nodes.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    met = links(firsts.select("fp"))
    for c in ("a", "b"):
        met = met.join(firsts.select(F.col("fp").alias(c), F.col("first").alias("node" + c)), c)
    return same.union(met.select(F.least("nodea", "nodeb"), F.greatest("nodea", "nodeb")))


def similar_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id", similarity: float = 0.8, shingle: int = 5, hot: int = 64, hot_again: int = 1024, per_member: int = 8, pivots: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, uid, first_id, first``; near copies by verified similarity.

    A node is a set of word n-grams; texts with equal sets are one. The first candidates are those of SimHash (see
    ``fingerprint_pairs``). Fingerprints 3 bits apart are closer than the similarity asks for, so a prefix filter gives
    the rest, which loses nothing: put in one order, two sets of Jaccard ``similarity`` or more share one of the first
    fifth or so of their shingles, and at the first one that they share, enough of both is left. Pairs that pass have
    their parity sketches compared, which bounds how far the sets are apart, then the whole sets, and link at
    ``similarity`` or more.

    1. The order puts shingles that are common in a sample last. A shingle gives at most ``per_member`` pairs for each
       of its members; one that would give more is a crowd: each member is compared with the member that has the most
       shared shingles. A crowd whose members are in one tree by now is done, mostly a family of near copies; one that
       has up to ``pivots`` pairs for each member between its trees is compared whole.
    2. Texts of other crowds, or with a shingle in ``hot`` texts of the sample, are searched again by themselves, with
       their shingles ordered by exact counts among them; those in over ``hot_again`` of them are crowds from the start.
    3. In crowds that are left, each member is compared with the member that has the most shared shingles, then those
       outside the largest tree with ``pivots`` members of it, then these with all members of other trees. Pairs left
       out could only join what is joined.

    ``first_id`` is the smallest id of the group and ``first`` is true for the one row that stands for it.
    ``uid`` is a hash of text and id. Empty texts form no group. Rows that repeat id and text are one. Null ids sort last.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0, at most 1")
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    uid = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(id_col).cast("long"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), uid.alias("uid"), F.col(text).alias("text"))
    common = context.broadcast(_common(rows, shingle))
    found = rows.mapInArrow(lean(_prefixes(shingle, similarity, hot, common)), "doc_id long, uid long, node long, fp long, size int, cold int, bits binary, prefix array<long>")
    found = materialize(found, "similar-prefixes")
    nodes = found.where("size > 0").groupBy("node").agg(F.min("uid").alias("uid"), F.min("fp").alias("fp"), F.min("size").alias("size"), F.first("bits").alias("bits"))
    nodes = materialize(nodes, "similar-nodes")
    others = found.where("size > 0").select("node", "uid").join(nodes.select("node", F.col("uid").alias("first")), "node").where("uid <> first").select("uid").distinct()
    sole = found.where("size > 0").join(held(materialize(others, "similar-others")), "uid", "left_anti")

    def searched(entries: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs and crowds of ``shingle, node, size, rest``."""
        entries = entries.repartition("shingle").sortWithinPartitions("shingle", "node")
        met = materialize(entries.mapInArrow(lean(_candidates(similarity, per_member)), "shingle long, a long, b long, size int, rest int"), name)
        return met.where("shingle is null").select("a", "b"), met.where("shingle is not null").select("shingle", F.col("a").alias("node"), "size", "rest")

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave the similarity possible, each once."""

        def run(batches):
            for b in batches:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(b.num_rows, SKETCH // 64) for c in ("x", "y"))
                total = b.column("m").to_numpy() + b.column("n").to_numpy()
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                yield b.select(["a", "b"]).filter(pa.array(apart <= total * (1 - similarity) / (1 + similarity) + EPS))

        pairs = pairs.distinct()
        for c, x, n in (("a", "x", "m"), ("b", "y", "n")):
            pairs = pairs.join(nodes.select(F.col("node").alias(c), F.col("bits").alias(x), F.col("size").alias(n)), c)
        return pairs.mapInArrow(run, "a long, b long")

    def side(c: str) -> list[Column]:
        return [F.col(x).alias(x + c) for x in ("node", "size", "rest")]

    def paired(met: DataFrame) -> DataFrame:
        """Of rows with two members' ``node, size, rest`` (and an a or b after): the pairs that are possible."""
        ok = _possible(F.col("sizea"), F.col("resta"), F.col("sizeb"), F.col("restb"), similarity)
        return met.where((F.col("nodea") != F.col("nodeb")) & ok).select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b"))

    def at_hubs(crowd: DataFrame) -> DataFrame:
        """Possible pairs of each member of a crowd with the one that has the most shared shingles."""
        hubs = crowd.groupBy("shingle").agg(F.max(F.struct((F.col("rest") / F.col("size")).alias("share"), "node", "size", "rest")).alias("hub"))
        hubs = hubs.select("shingle", F.col("hub.node").alias("nodeb"), F.col("hub.size").alias("sizeb"), F.col("hub.rest").alias("restb"))
        return paired(crowd.select("shingle", *side("a")).join(hubs, "shingle"))

    def open_crowds(crowd: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Members of crowds with their trees' roots; the crowds that have several trees, each with its largest."""
        here = crowd.join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
        here = materialize(here, f"similar-rooted-{name}")
        largest = here.groupBy("shingle", "root").agg(F.count("*").alias("n")).groupBy("shingle")
        largest = largest.agg(F.max(F.struct("n", "root")).alias("t"), F.count("*").alias("trees"), F.sum("n").alias("m"), ((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("apart"))
        return here, materialize(largest.where("trees > 1").select("shingle", F.col("t.root").alias("top"), (F.col("apart") <= pivots * F.col("m")).alias("few")), f"similar-open-{name}")

    def between(here: DataFrame, pivots: int | None = None) -> DataFrame:
        """Possible pairs between the trees of open crowds; of the largest tree all members or ``pivots``, and no others then."""
        outside = here.where("root <> top").select("shingle", *side("a"), F.col("root").alias("roota"))
        others = here.select("shingle", *side("b"), F.col("root").alias("rootb"), "top")
        if pivots is not None:
            nth = F.row_number().over(Window.partitionBy("shingle").orderBy(F.xxhash64("nodeb")))
            others = others.where("rootb = top").withColumn("nth", nth).where(F.col("nth") <= pivots)
        # Of two outside the largest tree, one order is enough.
        return paired(outside.join(others, "shingle").where("roota <> rootb and (rootb = top or nodea < nodeb)"))

    begins = F.posexplode(F.slice("prefix", 1, F.col("cold"))).alias("pos", "shingle")
    entries = sole.select("node", "size", begins).select("shingle", "node", "size", (F.col("size") - F.col("pos")).cast("int").alias("rest"))
    pairs, crowd = searched(entries, "similar-met")
    simhashed = fingerprint_pairs(nodes.select("node", "fp"))
    pairs = materialize(near(simhashed.union(pairs).union(at_hubs(crowd))), "similar-pairs")
    hot_ones = sole.where("cold < size(prefix)").select("node")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(crowd.select("node")).union(hot_ones).distinct()
    wanted = materialize(wanted.join(nodes, "node").select("node", "uid"), "similar-wanted")
    box = context.broadcast(bloom(wanted))
    some = rows.select("uid", "text").withColumns(bloom_bits())

    def sets(batches):
        seen: set[int] = set()
        for b in batches:
            b = b.filter(pa.array(in_bloom(b, box.value), pa.bool_()))
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100)
                new = [k for k, u in enumerate(part.column("uid").to_pylist()) if not (u in seen or seen.add(u))]
                part = part.take(pa.array(new, pa.int64()))
                grams = [shingles(t.as_py(), shingle) for t in part.column("text").cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("uid"), pa.array(grams, pa.list_(pa.int64()))], ["uid", "grams"])

    # A row that is there again in another task just gives a link twice.
    texts = materialize(some.mapInArrow(lean(sets), "uid long, grams array<long>").join(held(wanted), "uid").select("node", "grams"), "similar-sets")

    def close(pairs: DataFrame) -> DataFrame:
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared) - EPS).select("a", "b")

    linked = materialize(close(pairs), "similar-links")
    trees = connected_components(linked)
    here, largest = open_crowds(crowd, "first")
    more = near(between(here.join(held(largest.where("few")), "shingle")))
    again = materialize(here.join(held(largest.where("not few")), "shingle", "left_semi").select("node").union(hot_ones).distinct(), "similar-again")
    crowded = again.limit(1).count() > 0
    if crowded:
        members = texts.join(held(again), "node").dropDuplicates(["node"]).select("node", F.size("grams").alias("size"), F.explode("grams").alias("shingle"))
        counts = materialize(members.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1"), "similar-counts")
        ranked = members.join(counts, "shingle").groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("l"))
        ranked = ranked.select("node", "size", F.size("l").alias("shared"), F.posexplode("l").alias("pos", "e"))
        ranked = ranked.select("e.shingle", "e.n", "node", "size", (F.col("shared") - F.col("pos")).cast("int").alias("rest"))
        ranked = materialize(ranked.where(F.col("rest") >= F.ceil(similarity * F.col("size") - EPS)), "similar-ranked")
        found_again, crowd = searched(ranked.where(F.col("n") <= hot_again).drop("n"), "similar-met-again")
        crowd = materialize(crowd.union(ranked.where(F.col("n") > hot_again).drop("n")), "similar-crowd")
        crowded = crowd.limit(1).count() > 0
        more = more.union(near(found_again.union(at_hubs(crowd))))
    more = materialize(more.join(pairs, ["a", "b"], "left_anti").distinct(), "similar-pairs-again")
    pairs = pairs.union(more)
    more = materialize(close(more), "similar-links-again")
    if more.limit(1).count():
        linked = linked.union(more)
        trees = connected_components(linked)

    for name in ("pivots", "rest") if crowded else ():
        here, largest = open_crowds(crowd, name)
        if not largest.limit(1).count():
            break
        here = here.join(largest, "shingle")
        more = materialize(near(between(here, pivots if name == "pivots" else None)).join(pairs, ["a", "b"], "left_anti"), f"similar-pairs-{name}")
        pairs = pairs.union(more)
        more = materialize(close(more), f"similar-links-{name}")
        if more.limit(1).count():
            linked = linked.union(more)
            trees = connected_components(linked)

    root = F.when(F.col("size") > 0, F.coalesce("root", "node"))
    named = found.select("doc_id", "uid", "node", "size").join(trees, "node", "left").select("doc_id", "uid", root.alias("root"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid")
    named = materialize(named, "similar-named")
    first = named.where("root is not null").groupBy("root").agg(F.min(order).alias("f"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    out = named.join(first, "root", "left")
    alone = F.col("f").isNull()
    return out.select("doc_id", "uid", F.when(alone, F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("first_id"), (alone | (F.col("f.uid") == F.col("uid"))).alias("first"))


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (SimHash, checked and completed at a similarity of 0.8 or more of five-word shingles) the row of smallest id stays, with all columns.

    Rows that repeat id and text are one text and stay or go together; empty texts and null texts stay.
    """
    same_id, same_uid = unused(docs, "id", "uid")
    with scratch() as tables:
        gone = similar_groups(docs).where("not first").select(F.col("doc_id").alias(same_id), F.col("uid").alias(same_uid)).distinct()
        gone = held(tables.keep(materialize(gone, "simhash-gone")))
    uid = F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long"))
    return docs.join(gone, (uid == F.col(same_uid)) & F.col("doc_id").cast("long").eqNullSafe(F.col(same_id)), "left_anti")
