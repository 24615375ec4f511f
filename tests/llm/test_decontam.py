import random

import numpy as np
import pytest

from rangeloom.llm import decontam

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, item_id long, score string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def plain_scores(index, ids):
    """All items against the set of terms of one passage."""
    terms = set(ids[ids >= 0].tolist())
    out = np.zeros(len(index.ids))
    for t in terms:
        for i, x in zip(index.lists[t][0], index.lists[t][1], strict=True):
            out[i] += x
    return out


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 2, 3)))) for _ in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_search_equals_scoring_everything(threshold):
    rng = random.Random(int(threshold * 10))
    items = [(i, " ".join(words(rng, rng.randrange(1, 40), "abcd"))) for i in range(150)]
    index = decontam.Index(items, threshold)
    texts = [" ".join(words(rng, rng.randrange(0, 300), "abcde")) for _ in range(60)]
    texts += [" ".join(words(rng, 30)) + " " + t for _, t in items[:40]]
    docs = [index.numbers(t) for t in texts]
    open_windows = set(index.windows(docs))
    hits = 0
    for d, ids in enumerate(docs):
        for first in range(-(-len(ids) // index.step)):
            part = ids[first * index.step : (first + 2) * index.step]
            want = plain_scores(index, part)
            good = {k for k in range(len(want)) if want[k] >= threshold - 1e-12}
            hits += len(good)
            assert not good or (d, first) in open_windows
            got = dict(index.wand(set(part[part >= 0].tolist())))
            assert set(got) == good and all(abs(got[k] - want[k]) < 1e-9 for k in good)
    assert hits > 40


def test_planted_items_are_found_and_nothing_else(spark):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 30, "abcdefghijklmnop")).capitalize() + ".") for i in range(40)] + [(90, "What is the name of the river? Zambaro of the north"), (91, ""), (92, None), (93, "short one"), (94, "...")]
    clean = [(i, " ".join(words(rng, rng.randrange(5, 900), "abcdefghijklmnop"))) for i in range(120)]
    rows, want = list(clean), set()
    for k in range(0, 40, 2):
        t = clean[k][1].split()
        at = rng.randrange(len(t))
        body = items[k][1].upper() if k % 4 else items[k][1].replace(" ", ",  ")
        rows.append((1000 + k, " ".join([*t[:at], body, *t[at:]])))
        want.add((1000 + k, k))
    half = items[1][1].split()
    rows += [(2000, " ".join(half[:18])), (2001, " ".join(half[20:])), (2002, "it asks what is the name of the river zambaro of the north indeed"), (2003, "what is the name of the river asked nobody"), (2004, None), (2005, ""), (None, items[3][1]), (2006, "x " * 50_000 + items[5][1])]
    want |= {(2002, 90), (None, 3), (2006, 5)}
    got = decontam.contaminated(docs_of(spark, rows), items_of(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert all(r.score >= 0.5 and r.question_overlap >= 0.5 and r.answer_overlap >= 0.5 for r in got)


def test_slices_of_a_large_benchmark_find_the_same(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, 20, "abcdefghijklmnop"))) for i in range(30)]
    docs = docs_of(spark, [(i, "before " + t + " after") for i, t in items])
    one = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items_of(spark, items)).collect()}
    monkeypatch.setattr(decontam, "indexes", lambda b, threshold=0.5, f=decontam.indexes: f(b, threshold, max_bytes=500))
    assert len(decontam.indexes(items_of(spark, items))) > 2
    assert one == {(i, i) for i in range(30)} == {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items_of(spark, items)).collect()}


def test_empty_tables_and_stage(spark, tmp_path):
    items = [(1, " ".join(words(random.Random(1), 25, "abcdefghijklmnop")))]
    assert decontam.contaminated(docs_of(spark, []), items_of(spark, items)).count() == 0
    assert decontam.contaminated(docs_of(spark, [(1, "text")]), items_of(spark, [])).count() == 0
    items_of(spark, items).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = docs_of(spark, [(1, "clean words"), (2, "so " + items[0][1]), (3, None), (3, None)])
    out = decontam.decontamination_stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 3] and out.columns == docs.columns


def test_items_without_an_id_count(spark):
    rng = random.Random(31)
    text = [" ".join("".join(rng.choice("pqrstuvw") for _ in range(6)) for _ in range(30)) for _ in range(3)]
    items = spark.createDataFrame([(1, text[0]), (None, text[1]), (None, text[2])], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"before it {t} after it") for k, t in enumerate(text)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()} == {(0, 1), (1, None), (2, None)}


def test_scores_do_not_depend_on_slices(spark):
    rng = random.Random(32)
    rows = [(i, " ".join(words(rng, rng.choice([12, 30, 70])))) for i in range(40)]
    (one,), many = decontam.indexes(items_of(spark, rows)), decontam.indexes(items_of(spark, rows), max_bytes=1000)
    assert len(many) > 3 and {x.step for x in many} == {one.step}

    def impacts(index):
        return {(index.ids[i], t): round(x, 12) for t, k in index.terms.items() for i, x in zip(*index.lists[k][:2], strict=True)}

    assert {k: v for x in many for k, v in impacts(x).items()} == impacts(one)
