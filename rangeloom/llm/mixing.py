"""Mixing sources to target weights: min-cost flow over membership patterns, then a seeded selection."""

from __future__ import annotations

import heapq
from collections import Counter
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, table, unused

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2


def source_targets(sizes: list[tuple], weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> list[float]:
    """Targets of ``(source, size)``, given in order; weights repeat over the sources.

    ``share`` of all sizes is dealt by weight. A source whose part is over ``repeats`` times its size stays
    there, and the excess is dealt anew to the others until none is above.
    """
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    cap, total = [repeats * s for _, s in sizes], sum(s for _, s in sizes)
    open_, held = set(range(len(sizes))), 0
    while open_:
        rate = (share * total - held) / sum(w[i] for i in open_)
        full = {i for i in open_ if rate * w[i] > cap[i]}
        if not full:
            return [rate * w[i] if i in open_ else float(cap[i]) for i in range(len(sizes))]
        open_ -= full
        held += sum(cap[i] for i in full)
    return [float(c) for c in cap]


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[dict[int, int]]:
    """Words that each pattern (members, words) gives to each of its sources.

    Nodes: a start, the patterns, the sources, an end. From the start to a pattern runs an arc for each
    repetition, with the pattern's words as capacity and cost 1, 3, 5, ... (the steps of a
    square, so convex): no second repetition is bought while a first one can meet the quota. Successive
    shortest paths with potentials; the graph grows with patterns, not with documents.
    """
    n_p, n_s = len(patterns), len(quotas)
    end = 1 + n_p + n_s
    graph: list[list[int]] = [[] for _ in range(end + 1)]
    to, cap, cost = [], [], []

    def arc(u, v, c, w):
        for x, y, k, p in ((u, v, c, w), (v, u, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(p)

    for p, (members, words) in enumerate(patterns):
        for r in range(repeats):
            arc(0, 1 + p, words, 2 * r + 1)
        for s in members:
            arc(1 + p, 1 + n_p + s, repeats * words, 0)
    for s, q in enumerate(quotas):
        arc(1 + n_p + s, end, q, 0)
    high = [0] * (end + 1)
    while True:
        dist, via, heap = [float("inf")] * (end + 1), [-1] * (end + 1), [(0, 0)]
        dist[0] = 0
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            for e in graph[u]:
                nd = d + cost[e] + high[u] - high[to[e]]
                if cap[e] and nd < dist[to[e]]:
                    dist[to[e]], via[to[e]] = nd, e
                    heapq.heappush(heap, (nd, to[e]))
        if via[end] < 0:
            break
        high = [h + (d if d < float("inf") else 0) for h, d in zip(high, dist, strict=True)]
        path, v = [], end
        while v:
            path.append(via[v])
            v = to[via[v] ^ 1]
        f = min(cap[e] for e in path)
        for e in path:
            cap[e] -= f
            cap[e ^ 1] += f
    out = []
    for p, (members, _) in enumerate(patterns):
        back = {to[e] - 1 - n_p: cap[e ^ 1] for e in graph[1 + p] if to[e] > n_p}
        out.append({s: back.get(s, 0) for s in members})
    return out


def route(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS, max_patterns: int = 20_000) -> list[dict[int, int]]:
    """``min_cost_flow``, but for sources that share no document: such a source takes its quota from its one pattern, as far as that goes.

    Over ``max_patterns`` patterns of other sources raise.
    """
    met = Counter(s for members, _ in patterns for s in members)
    alone = [len(members) == 1 and met[members[0]] == 1 for members, _ in patterns]
    shared = [p for p, a in zip(patterns, alone, strict=True) if not a]
    if len(shared) > max_patterns:
        raise ValueError(f"over {max_patterns} membership patterns of sources that share documents")
    named = sorted({s for members, _ in shared for s in members})
    at = {s: i for i, s in enumerate(named)}
    flows = iter(min_cost_flow([(tuple(at[s] for s in members), words) for members, words in shared], [quotas[s] for s in named], repeats))
    out = []
    for (members, words), a in zip(patterns, alone, strict=True):
        out.append({members[0]: min(quotas[members[0]], repeats * words)} if a else {named[k]: f for k, f in next(flows).items()})
    return out


def mix(docs: DataFrame, members: Column | None = None, text: str = "text", id_col: str = "doc_id", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0, max_patterns: int = 20_000, max_rows: int = 1_000_000, bucket_bits: int = 12, key: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, pattern, size, source_size, target, taken``.

    ``members`` is an array of the sources a document belongs to (default: its one ``source``; null is a
    source of its own, last in order). Sizes are counted in words. Documents are summed by
    membership pattern; the driver gets one row per pattern and routes words to the sources' quotas. It raises over
    ``max_rows`` patterns, or over ``max_patterns`` of sources that share documents with others. A pattern that gives F of its W words takes
    every document F // W times and the rest by documents in a seeded order; the one at the edge gives
    as many words of a repeat as are missing, so quotas are met to the word. Positions in that order
    come from sums over 2^``bucket_bits`` ranges of the hash; only the range at the edge is ordered.

    Null text has size 0 and takes 0. Repeated rows count each. An empty table gives no rows. ``source_size`` and
    ``target`` are sums over the members for a document in several sources. ``key`` tells rows of one id apart: it
    orders them and is a last column of the result.
    """
    keys = [] if key is None else ["key"]
    if members is None:
        members = F.array(F.col("source"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(members)).alias("pattern"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), order.alias("order"), *([] if key is None else [key.alias("key")]))
    rows = materialize(rows.withColumn("bucket", F.conv(F.substring("order", 1, 8), 16, 10).cast("long").bitwiseAND((1 << bucket_bits) - 1)), "mix-sizes")
    found = rows.groupBy("pattern").agg(F.sum("size").alias("words")).limit(max_rows + 1).collect()
    if len(found) > max_rows:
        raise ValueError(f"over {max_rows} membership patterns")

    names = sorted({s for r in found for s in r.pattern}, key=lambda s: (s is None, (s or "").encode()))
    at = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for r in found:
        for s in r.pattern:
            sizes[at[s]] += r.words
    targets = source_targets(list(zip(names, sizes, strict=True)), weights, share, repeats)
    flows = route([(tuple(at[s] for s in r.pattern), r.words) for r in found], [int(t + 0.5) for t in targets], repeats, max_patterns)
    plan = [(r.pattern, sum(sizes[at[s]] for s in r.pattern), sum(targets[at[s]] for s in r.pattern), *divmod(sum(f.values()), max(r.words, 1))) for r, f in zip(found, flows, strict=True)]
    spark = docs.sparkSession
    kind = rows.schema["pattern"].dataType.simpleString()
    plan = F.broadcast(spark.createDataFrame(plan, f"p {kind}, source_size long, target double, copies long, rest long"))

    sums = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = F.sum("in_bucket").over(Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    edge = sums.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, _same("pattern", "p")).where("before <= rest and rest < before + in_bucket")
    edge = materialize(edge.select(F.col("pattern").alias("e"), F.col("bucket").alias("edge"), "before"), "mix-edges")  # a row per pattern at most
    rows = rows.join(plan, _same("pattern", "p")).drop("p").join(F.broadcast(edge), _same("pattern", "e"), "left").drop("e")
    whole = rows.where("edge is null or bucket <> edge").withColumn("part", F.when(F.col("bucket") < F.col("edge"), F.col("size")).otherwise(0))
    ahead = F.sum("size").over(Window.partitionBy("pattern").orderBy("bucket", "order", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1))
    cut = rows.where("bucket = edge").withColumn("ahead", F.col("before") + F.coalesce(ahead, F.lit(0)))
    cut = cut.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))).drop("ahead")
    return whole.union(cut.select(*whole.columns)).select("doc_id", "pattern", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).cast("long").alias("taken"), *keys)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def op10_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s0
), s2 AS (
  SELECT *, 2 * source_size AS cap, row_number() OVER (ORDER BY 2 * source_size / w, source NULLS LAST) AS k,
    sum(source_size) OVER () AS total FROM s1
), s3 AS (  -- rate if the sources before this one, in order of cap / w, are at their caps
  SELECT *, (1.5 * total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM s2
), s4 AS (
  SELECT *, (SELECT arg_min(rate, k) FROM s3 WHERE rate * w <= cap) AS r, (SELECT min(k) FROM s3 WHERE rate * w <= cap) AS k0 FROM s3
), s5 AS (
  SELECT source, source_size, CASE WHEN k >= k0 THEN r * w ELSE cap::DOUBLE END AS target FROM s4
), s6 AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota FROM s5
), t AS (
  SELECT d.doc_id, d.size::BIGINT AS size, source_size, target, quota // greatest(source_size, 1) AS copies, quota % greatest(source_size, 1) AS rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY (('0x' || substr(h, 1, 8))::BIGINT & 4095), h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
)
SELECT doc_id, size, source_size, target, (copies * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM t
"""


def mixing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the documents of the mix with what each gives: ``size, source_size, target, taken``; those that give nothing go.

    A column of the documents with one of these names comes out with ``_0`` (or the next free number) at its end.
    """
    own = ("size", "source_size", "target", "taken")
    for c in docs.columns:
        if c.lower() in own:
            docs = docs.withColumnRenamed(c, next(n for n in (f"{c}_{k}" for k in count()) if n.lower() not in map(str.lower, docs.columns)))
    i, s, z, k, nth = unused(docs, "id", "source", "size", "key", "nth")
    on = {i: F.col("doc_id"), s: F.col("source"), z: F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"), k: F.xxhash64("text")}
    plan = mix(docs, key=on[k]).select(F.col("doc_id").alias(i), F.col("pattern")[0].alias(s), F.col("size").alias(z), F.col("key").alias(k), "source_size", "target", "taken")
    plan = materialize(plan, "mix-plan")
    alike = plan.groupBy(*on).agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.min("taken").alias("low"), F.max("taken").alias("taken"))
    alike = materialize(alike.where("taken > 0"), "mix-alike")
    names = docs.columns
    left = docs.withColumns(on)

    def matched(rows: DataFrame, to: DataFrame, by: list[str], give: tuple) -> DataFrame:
        """``rows`` that meet a row of ``to``, with what that gives."""
        other = unused(rows, *(n + "_to" for n in by))
        to = to.select(*(F.col(n).alias(o) for n, o in zip(by, other, strict=True)), *give)
        met = F.lit(True)
        for n, o in zip(by, other, strict=True):
            met &= F.col(n).eqNullSafe(F.col(o))
        return rows.join(to, met).drop(*other)

    def given(rows: DataFrame) -> DataFrame:
        return rows.select(*names, F.col(z).alias("size"), *own[1:])

    out = given(matched(left, alike.where("low = taken"), list(on), own[1:]))
    uneven = alike.where("low <> taken").select(*on)
    if not uneven.limit(1).count():
        return out
    # Rows alike in all of this of which the mix takes unequal parts, at the edge: they are numbered and dealt out one by one.
    parts = matched(plan, uneven, list(on), ()).withColumn(nth, F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("taken")))).where("taken > 0")
    rest = matched(left, uneven, list(on), ()).withColumn(nth, F.row_number().over(Window.partitionBy(*on).orderBy(z)))
    return out.union(given(matched(rest, parts, [*on, nth], own[1:])))
