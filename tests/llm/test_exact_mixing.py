import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import exact, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, size string, h string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, None, None, None) for i, t, s in rows], SCHEMA)


ROWS = [(7, "a  b", "x"), (3, "a\tb", "x"), (5, "a b ", "x"), (None, None, None), (9, "", "y"), (4, " ", "y"), (4, "\n", "y"), (3, "a b", "x"), (None, "z" * 300_000, None)]
ROWS += [(100 + i, f"text {i % 37}", "x") for i in range(200)]


def plain(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(norm.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_equals_plain_grouping(spark, bits):
    got = exact.exact_groups(docs_of(spark, ROWS), capacity=16, hash_bits=bits).drop("bucket").collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


@pytest.mark.parametrize("most", [0, 1000])
def test_exact_with_hashes_shuffled_or_broadcast(spark, most):
    got = exact.exact_groups(docs_of(spark, ROWS), capacity=1, max_depth=5, most=most).drop("bucket").collect()
    assert sorted(map(tuple, got), key=str) == plain(ROWS)


def test_each_bucket_is_one_file_of_its_owner(spark):
    from pathlib import Path

    df = spark.range(1000).selectExpr("id % 7 bucket", "id h").withColumn("bucket", F.col("bucket").cast("int")).repartition(4)
    stored = exact._owned(df, 7, "owned", "h")
    folders = sorted(Path(stored.inputFiles()[0].removeprefix("file://")).parent.parent.glob("bucket=*"))
    assert len(folders) == 7 and all(len(list(f.glob("part-*"))) == 1 for f in folders)
    assert sorted(map(tuple, stored.collect())) == sorted((i % 7, i) for i in range(1000))


def test_exact_empty_table(spark):
    assert exact.exact_groups(docs_of(spark, [])).count() == 0


def test_directory_splits_only_overfull_buckets():
    got = exact.directory([(0, 10), (1, 10), (8, 3), (15, 3)], 12, 4)
    assert [c for lo, hi, _ in got for c in range(lo, hi + 1)] == list(range(16))
    assert (0, 0, 0) in got and (1, 1, 1) in got and (8, 15, got[-1][2]) in got
    assert exact.directory([(3, 99)], 12, 2)[-1][1] == 3  # one crowded range at full depth just stays


def test_exact_stage_keeps_the_first_row_whole(spark):
    out = exact.exact_stage(spark, docs_of(spark, ROWS), "")
    assert out.columns == docs_of(spark, []).columns
    got = sorted((str(r.doc_id), re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in out.collect())
    assert got == sorted((str(i), n) for n, i in {(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), k) for t, k in [(t, next(x[1] for x in plain(ROWS) if x[4] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest())) for _, t, _ in ROWS]})


def test_targets_stop_at_twice_the_size_and_reshare():
    got = mixing.source_targets([("a", 10), ("b", 1000), ("c", 1000)])
    assert got[0] == 20.0 and abs(sum(got) - 1.5 * 2010) < 1e-6
    assert abs(got[2] - 2 * got[1]) < 1e-6 or got[2] == 2000.0
    assert mixing.source_targets([]) == [] and mixing.source_targets([("a", 0)]) == [0.0]


def test_flow_meets_quotas_of_overlapping_sources_with_fewest_repeats():
    flows = mixing.min_cost_flow([((0,), 100), ((0, 1), 100), ((1,), 10)], [150, 60])
    assert sum(f.get(0, 0) for f in flows) == 150 and sum(f.get(1, 0) for f in flows) == 60
    assert all(sum(f.values()) <= w for f, w in zip(flows, (100, 100, 10), strict=True))  # 210 words: no second copy
    flows = mixing.min_cost_flow([((0,), 100)], [170])
    assert flows == [{0: 170}]


def test_routes_equal_the_flow_over_all_patterns():
    import random

    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(1, 6)
        patterns = list({tuple(sorted(rng.sample(range(n), rng.randrange(1, min(n, 3) + 1)))) for _ in range(rng.randrange(1, 6))})
        patterns = [(p, rng.randrange(1, 50)) for p in patterns]
        quotas = [rng.randrange(0, 60) for _ in range(n)]
        given = lambda flows: [sum(f.get(s, 0) for f in flows) for s in range(n)]  # noqa: B023, E731
        price = lambda flows: sum(min(t, w) + 3 * max(0, t - w) for (_, w), t in zip(patterns, (sum(f.values()) for f in flows), strict=True))  # noqa: B023, E731
        a, b = mixing.route(patterns, quotas), mixing.min_cost_flow(patterns, quotas)
        assert sum(given(a)) == sum(given(b)) and price(a) == price(b)
    many = [((k,), 10) for k in range(50_000)]
    assert mixing.route(many, [15] * 50_000) == [{k: 15} for k in range(50_000)]
    with pytest.raises(ValueError):
        mixing.route([((0, 1), 1), ((0,), 1)], [1, 1], max_patterns=1)


def test_mix_meets_targets_to_the_word(spark):
    rows = [(i, "w " * (i % 50), f"s{i % 3}") for i in range(300)] + [(1000, None, None), (1001, "lone word", None), (1, "w", "s1"), (None, "no id", "s0")]
    got = mixing.mix(docs_of(spark, rows), bucket_bits=3).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[tuple(r.pattern)].append(r)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert sum(r.taken for r in rs) == int(rs[0].target + 0.5)
        assert sum(1 for r in rs if r.size and r.taken not in (0, r.size, 2 * r.size)) <= 1
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(7), bucket_bits=3).collect()
    key = lambda r: str((r.doc_id, r.size, r.taken))
    assert sorted(map(key, again)) == sorted(map(key, got))


def test_mix_empty_and_overlapping(spark):
    from pyspark.sql import functions as F

    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(i, "w " * 10, "a" if i % 2 else "a,b") for i in range(40)]
    got = mixing.mix(docs_of(spark, rows), members=F.split("source", ","), bucket_bits=2).collect()
    assert all(r.taken <= 20 for r in got)
    out = mixing.mixing_stage(spark, docs_of(spark, rows), "")
    assert {"taken", "size", "target", "source_size", "text", "source"} <= set(out.columns) and out.count() == sum(1 for r in mixing.mix(docs_of(spark, rows)).collect() if r.taken)


def test_mixing_stage_tells_rows_of_one_id_apart(spark):
    rows = [(7 if i % 2 else None, f"w{i % 12} of four words"[: -1 - i % 3], None, f"s{i % 4}", 0) for i in range(96)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = mixing.mix(docs).where("taken > 0").collect()
    got = mixing.mixing_stage(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.pattern[0]), r.size, r.taken) for r in want) == sorted((str(r.doc_id), str(r.source), r.size, r.taken) for r in got)
    total, target = {}, {r.source: r.target for r in got}
    for r in got:
        total[r.source] = total.get(r.source, 0) + r.taken
    assert total == {s: int(t + 0.5) for s, t in target.items()}
