import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rangeloom.llm import suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, h string, v string, spans int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, None, None, None) for i, t in rows], SCHEMA)


def plain(rows, length):
    """Every window of every text, counted."""
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d) + 2, np.int8)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = 1
        kept = bytes(b for b, g in zip(d, gone[1:], strict=False) if not g)
        out.append((i, len(d), len(d) - len(kept), int((np.diff(gone) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = suffix.dedup_repeats(docs_of(spark, rows), **kw).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("letters", [1, 2, 4, 300])
def test_suffix_array_equals_sorted_suffixes(letters):
    rng = np.random.default_rng(letters)
    for n in [*range(30), 100, 101, 102]:
        s = rng.integers(1, letters + 1, n)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


def test_suffix_array_to_a_depth_keeps_equal_prefixes_together():
    rng = np.random.default_rng(5)
    for _ in range(60):
        s = np.concatenate([np.tile(rng.integers(1, 4, 7), 9), rng.integers(1, 3, 40)])
        order = suffix.suffix_array(s, 8)
        assert sorted(order.tolist()) == list(range(len(s)))
        prefixes = [tuple(s[i : i + 8].tolist()) for i in order]
        assert prefixes == sorted(prefixes)


def test_runs_depend_on_the_window_alone_and_cover_all_starts():
    rng = random.Random(4)
    data = bytes(rng.choice(b"ab") for _ in range(600))
    h, p, lo, hi = suffix.runs(data, 40, 8)
    anchor = {s: (int(a), int(q) - s) for a, q, x, y in zip(h, p, lo, hi, strict=True) for s in range(q - y, q - x + 1)}
    assert sorted(anchor) == list(range(561))
    for s in range(561):
        one = suffix.runs(data[s : s + 40], 40, 8)
        assert anchor[s] == (int(one[0][0]), int(one[1][0]))


def texts(rng, n):
    base = ["".join(rng.choice("abcdé \n") for _ in range(rng.randrange(0, 160))) for _ in range(n)]
    out = list(base)
    for t in base:
        k = rng.randrange(5)
        if k == 0:
            out.append(t)
        elif k == 1 and t:
            i = rng.randrange(len(t))
            out.append(t[:i] + rng.choice("xyz") + t[i + 1 :])
        elif k == 2:
            out.append(rng.choice(base)[:50] + t[20:70] + rng.choice(base)[10:60])
    return out


@pytest.mark.parametrize("crowd", [1024, 3])
def test_query_equals_counting_every_window(spark, crowd):
    rng = random.Random(crowd)
    rows = list(enumerate(texts(rng, 60)))
    shared = "".join(rng.choice("pqrstu") for _ in range(70))
    for k in range(25):  # one passage with different letters close to it, so its anchors are crowded
        rows.append((len(rows), "".join(rng.choice("mn") for _ in range(k)) + shared + "".join(rng.choice("mn") for _ in range(30 - k))))
    rows += [(900, "a" * 90), (901, "xyz" * 30), (902, None), (903, ""), (None, "a" * 35), (905, "q" * 31), (906, "q" * 32), (907, "q" * 33), (900, "a" * 90)]
    assert got(spark, rows, length=32, gram=8, crowd=crowd) == plain(rows, 32)


def test_full_length_and_long_text(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passage = " ".join(word() for _ in range(90))
    long = " ".join(word() for _ in range(60_000))
    rows = [(1, long[:200_000] + passage + long[200_000:]), (2, "before " + passage + " after"), (3, passage[1:399]), (4, passage[:399] + "!"), (5, long[1000:1450]), (6, "é" * 250)]
    assert got(spark, rows) == plain(rows, 400)


def test_pieces_of_a_very_long_text_join(monkeypatch):
    rng = random.Random(3)
    data = bytes(rng.choice(b"abc") for _ in range(3000))
    whole = [x.tolist() for x in suffix.runs(data, 64, 16)]
    monkeypatch.setattr(suffix, "PIECE", 500)
    cut = [x.tolist() for x in suffix.runs(data, 64, 16)]
    spread = lambda r: {(h, p, d) for h, p, lo, hi in zip(*r, strict=True) for d in range(lo, hi + 1)}
    assert spread(whole) == spread(cut)


def test_empty_table(spark):
    assert got(spark, []) == []
