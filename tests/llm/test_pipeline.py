"""The pipeline's stages on a small corpus, against plain Python."""

import random
from collections import defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from rangeloom.llm import simhash

from .test_models import LABELS, corpus

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    rows, labels = corpus(rng, 400)
    item = " ".join("".join(rng.choice("pqrstuvw") for _ in range(5)) for _ in range(30))
    base = [(i, t, la, f"s{i % 3}", len(t)) for i, t, la in rows]
    texts = {i: t for i, t, _ in rows}
    ids = [i for i, _, x in labels if not x and len(texts[i].split()) > 60][:30]
    extra, copies, near, leaks = [], set(), set(), set()
    for k, i in enumerate(ids):
        t = texts[i]
        if k % 3 == 0:
            extra.append((1000 + k, t.replace(" ", "  "), "aa", "s1", 0))
            copies.add(1000 + k)
        elif k % 3 == 1:
            extra.append((1000 + k, t.upper() if t != t.upper() else t.lower(), "aa", None, 0))
            near.add(1000 + k)
        else:
            extra.append((1000 + k, t + " " + item, "aa", "s0", 0))
            leaks.add(1000 + k)
    extra += [(5000, None, None, None, None), (5001, "", "aa", "s0", 0)]
    write(spark, tmp_path, base + extra, labels, [(1, item)])

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "mixing"]
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(f"{tmp_path}/stage-{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage-{k}")
        seen[name] = before, {r.doc_id: r.text for r in docs.collect()}
        assert all(before[i] == t for i, t in seen[name][1].items())

    before, after = seen["toxicity"]
    toxic = {i for i, _, x in labels if x}
    assert len((set(before) - set(after)) ^ toxic) < 15
    before, after = seen["exact dedup"]
    first = {}
    for i, t in sorted(before.items()):
        first.setdefault(" ".join((t or "").split(" ")).replace("  ", " "), i)
    assert set(after) == set(first.values()) and not copies & set(after)
    before, after = seen["simhash near-dedup"]
    grams = {i: set(simhash.shingles((t or "").encode()).tolist()) for i, t in before.items()}
    root = {i: i for i in before}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in before:
        for j in before:
            if i < j and grams[i] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert set(after) == {find(i) for i in before} and not near & set(after)
    before, after = seen["benchmark decontamination"]
    assert set(before) - set(after) == leaks & set(before)
    mixed = docs.collect()
    by = defaultdict(int)
    for r in mixed:
        by[r.source] += r.taken
        assert 0 < r.taken <= 2 * r.size
    target = {r.source: r.target for r in mixed}
    assert all(by[s] == int(target[s] + 0.5) for s in by)

    again = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in mixed)


CLASHES = ["_id", "_uid", "_i", "_s", "_key", "_source", "_size", "_nth", "_id_0", "_i_0", "_key_0", "uid", "node", "h", "size", "source_size", "target", "TAKEN", "keep_id", "kept", "sha", "y", "item"]


@pytest.mark.parametrize("k", range(5))
def test_stages_with_clashing_names_nulls_and_repeated_rows(spark, tmp_path, k):
    """Every column of the input comes out with its own values, whatever it is called."""
    rng = random.Random(30 + k)
    rows, labels = corpus(rng, 120)
    item = " ".join("".join(rng.choice("pqrstuvw") for _ in range(5)) for _ in range(30))
    base = [(i, t, la, f"s{i % 3}", len(t)) for i, t, la in rows]
    base += [(7, base[8][1], None, None, None), (7, base[8][1], None, None, None), (None, None, None, None, None), (None, "", None, "s0", 1), (None, "lone text", None, None, None), (9000, "wide " * 40_000, "aa", "s1", None), (9001, base[3][1] + " " + item, "aa", "s2", None)]
    write(spark, tmp_path, base, labels, [(1, item), (None, None)])
    extra = [F.concat_ws("|", F.lit(c), F.col("doc_id"), F.substring("text", 1, 40)).alias(c) for c in CLASHES]
    docs = spark.createDataFrame(base, SCHEMA).select("*", *extra)
    name, stage = corpus_pipeline.STAGES[k]
    plain = stage(spark, spark.createDataFrame(base, SCHEMA), str(tmp_path))
    out = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert out.schema == docs.schema
    key = lambda r: (str(r.doc_id), str(r.text)[:60], str(r.source), str(r["taken"]) if k == 4 else "")
    got = out.collect()
    assert got and sorted(map(key, got)) == sorted(map(key, plain.collect()))
    for r in got:
        for c in CLASHES:
            at = f"{c}_0" if k == 4 and c.lower() in ("size", "source_size", "target", "taken") else c
            assert r[at] == "|".join(x for x in (c, None if r.doc_id is None else str(r.doc_id), None if r.text is None else r.text[:40]) if x is not None)


@pytest.mark.parametrize("k", range(5))
def test_stages_of_an_empty_table(spark, tmp_path, k):
    write(spark, tmp_path, [], [], [])
    docs = spark.createDataFrame([], SCHEMA)
    out = corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path))
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)
