"""Classifiers: held-out accuracy, invariances and odd rows."""

import random
import zlib

import numpy as np
import pytest

from rangeloom.llm import common, langid, quality, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, y int, quality int, toxic int"
LABELS = "doc_id long, quality int, toxic int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, None, None, None, None, None, None) for i, t, la in rows], SCHEMA)


def corpus(rng, n=600):
    """Invented prose in two languages; toxic rows have insults, poor rows are shouted, starred or stuttered."""
    syllables = {"aa": ["ka", "lo", "mi", "ta", "ru"], "bb": ["sch", "en", "ber", "ung", "ich"]}
    rows, labels = [], []
    for i in range(n):
        lang = rng.choice(["aa", "bb"])
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(20, 200))]
        toxic, good = rng.random() < 0.2, rng.random() > 0.2
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["zarbo", "vlekk", "gnuff"]))
        if not good:
            kind = rng.randrange(3)
            words = [w.upper() + "!!" for w in words] if kind == 0 else [w + "***" for w in words] if kind == 1 else [w for w in words[:12] for _ in range(20)]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def data():
    return corpus(random.Random(8))


def accuracy(got, want, held):
    keep = [r for r in got if r.doc_id in want and held(r)]
    return sum(r.hit for r in keep) / len(keep), len(keep)


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 7, 123456789, None, -3)], "doc_id long")
    for r in df.select("doc_id", common.fold(df.doc_id, 5).alias("f")).collect():
        assert r.f == common.fold_of(r.doc_id, 5) == zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5


ODD = [(10_001, None, None), (10_002, "", "aa"), (10_003, "\x00   123 !!!", None), (10_004, "𝒜𝒷 日本 é" * 3, None), (10_004, "repeated id", "bb"), (None, "no id", "aa"), (10_005, "ka lo mi " * 60_000, "aa")]


def test_quality(spark, data):
    rows, labels = data
    net = quality.fit(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    got = quality.quality_scores(docs_of(spark, rows + ODD), net).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    want = {i: q for i, q, _ in labels}
    held = [r for r in got if r.doc_id in want and common.fold_of(r.doc_id, 5) == 0]
    assert len(held) > 80 and np.mean([(r.score >= 0.3) == want[r.doc_id] for r in held]) > 0.95


def test_quality_gradients_are_right():
    net, rng = quality.Network(3), np.random.default_rng(1)
    for name in ("table", "bias", "w", "wb", "out", "ob"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    x = rng.integers(97, 101, (3, 4 * quality.BLOCK + quality.WIDTH - 1)).astype(np.uint8)
    y, weight = np.array([1.0, 0.0, 1.0]), np.ones(3)
    _, grads = net.step(x, y, weight)
    for p, g in zip((net.table, net.bias, net.w, net.wb, net.out, net.ob), grads, strict=True):
        where = np.argsort(-np.abs(g).ravel())[:4]
        for k in where:
            old, h = p.ravel()[k], 1e-5
            p.ravel()[k] = old + h
            up = net.step(x, y, weight)[0]
            p.ravel()[k] = old - h
            down = net.step(x, y, weight)[0]
            p.ravel()[k] = old
            assert g.ravel()[k] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=1e-6)


def test_quality_reads_all_chunks_alike():
    net = quality.Network(1)
    net.top = np.random.default_rng(0).normal(0, 1, 2 * quality.HIDDEN + 1)
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 1000, 40_000)]
    alone = np.concatenate([net.score([t]) for t in texts])
    assert np.allclose(alone, net.score(texts)) and np.allclose(alone, net.score(texts[::-1])[::-1])
    changed = texts[-1][:-40] + bytes(40)
    assert not np.allclose(net.features([texts[-1]]), net.features([changed]))


def test_language(spark, data):
    rows, _ = data
    model = langid.fit(docs_of(spark, rows + ODD[:4]))
    assert sorted(model) == ["aa", "bb"]
    got = langid.language_of(docs_of(spark, rows + ODD), model).collect()
    want = {i: la for i, _, la in rows}
    held = [r for r in got if r.doc_id in want and common.fold_of(r.doc_id, 4) == 2]
    assert len(held) > 100 and np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.98
    odd = {r.doc_id: r for r in got if r.doc_id not in want and r.doc_id not in (10_004, None)}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 for k in (10_001, 10_002, 10_003)) and odd[10_005].lang_pred == "aa"
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_languages_in_groups_equal_all_at_once(spark):
    rng = random.Random(9)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    model = {f"l{k}": " ".join(word("abcdefgh"[k % 4 : k % 4 + 4]) for _ in range(100)) for k in range(7)}
    rows = [(i, " ".join(word("abcdefgh"[i % 5 : i % 5 + 3]) for _ in range(i % 9)), None) for i in range(60)] + [(99, None, None), (None, "12 !", None)]
    whole = langid.language_of(docs_of(spark, rows), model).collect()
    parted = langid.language_of(docs_of(spark, rows), model, group=2).collect()
    key = lambda r: (str(r.doc_id), r.lang_pred)
    assert sorted(map(key, whole)) == sorted(map(key, parted)) and len(whole) == len(rows)
    for a, b in zip(sorted(whole, key=key), sorted(parted, key=key), strict=True):
        assert a.score == pytest.approx(b.score, rel=1e-9)
    assert langid.Parser(model).predict([t for _, t, _ in rows]) == [(r.lang_pred, pytest.approx(r.score)) for r in sorted(whole, key=lambda r: [i for i, _, _ in rows].index(r.doc_id))]


def test_letters_beyond_the_first_plane_are_told_apart():
    adlam, other = "".join(chr(0x1E900 + k % 34) for k in range(400)), "漢字仮名交文"
    p = langid.Parser({"ff": adlam, "en": "plain words of a language"})
    assert p.predict([adlam[30:90]])[0][0] == "ff"
    counts = p.phrases([langid.letters(chr(0x10330) * 50), langid.letters(other)])
    assert counts[0].tolist() == [50, 50] and counts[1].tolist() == [len(other)] * 2


def test_language_without_labels(spark):
    df = docs_of(spark, [(1, "text", None), (2, None, "aa")])
    assert {(r.lang_pred, r.score) for r in langid.language_of(df, langid.fit(df)).collect()} == {("und", 0.0)}
    assert langid.language_of(docs_of(spark, []), {}).count() == 0


def plain_phrases(text, source):
    """Greedy longest phrases, straight from substrings."""
    n, at = 0, 0
    while at < len(text):
        k = at + 1
        while k < len(text) and text[at : k + 1] in source:
            k += 1
        at, n = k, n + 1
    return n


def test_phrases_equal_plain_cross_parsing():
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 6)))
    sources = {"x": " ".join(word("abc") for _ in range(200)), "y": " ".join(word("bcd") for _ in range(200))}
    p = langid.Parser(sources)
    texts = [" ".join(word("abcdq") for _ in range(n)) for n in (1, 5, 60)] + ["a", "q", "qq z"]
    clean = [langid.letters(t) for t in texts]
    got = p.phrases(clean)
    for row, c in zip(got.tolist(), clean, strict=True):
        t = "".join(map(chr, c))
        for k, lang in enumerate(p.langs):
            s = "".join(map(chr, langid.letters(sources[lang])))
            assert row[k] == plain_phrases(t, s)


def test_suffix_automaton_knows_exactly_the_substrings():
    text = "abcbcabb"
    goto = langid.suffix_automaton([ord(c) for c in text])

    def known(s):
        state = 0
        for c in s:
            if ord(c) not in goto[state]:
                return False
            state = goto[state][ord(c)]
        return True

    import itertools

    for n in range(1, 5):
        for s in itertools.product("abc", repeat=n):
            assert known("".join(s)) == ("".join(s) in text)


def test_toxicity(spark, data):
    rows, labels = data
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, LABELS))
    got = toxicity.toxicity_scores(docs_of(spark, rows + ODD), model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 for r in got)
    want = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in want and common.fold_of(r.doc_id, 5) == 0]
    assert len(held) > 80 and np.mean([(r.score >= 0.5) == want[r.doc_id] for r in held]) > 0.95


def test_no_labels(spark):
    docs, none = docs_of(spark, [(1, "text", "aa"), (2, None, None)]), spark.createDataFrame([], LABELS)
    assert {r.score for r in toxicity.toxicity_scores(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    assert {r.score for r in quality.quality_scores(docs, quality.fit(docs, none)).collect()} == {0.5}


def test_swaps_take_the_weight_off_group_names():
    """A corpus that insults mostly one group: without the penalty its name itself looks toxic."""
    rng = random.Random(5)
    filler = "people walk talk eat read sing here there now today".split()
    texts, labels = [], []
    for i in range(800):
        toxic = i % 4 == 0
        group = "muslim" if toxic and rng.random() < 0.9 else rng.choice(["christian", "jewish", "hindu", "buddhist"])
        words = [rng.choice(filler) for _ in range(15)] + [group] + (["awful", "zarbo"] if toxic and rng.random() < 0.8 else ["nice"])
        rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    plain, fair = toxicity.train(texts, labels, 0.0), toxicity.train(texts, labels)
    neutral = "people walk here with a muslim today and read there", "people walk here with a hindu today and read there"
    gap = lambda m: abs(m.word("muslim") - m.word("hindu"))
    assert gap(fair) < 0.4 * gap(plain)
    assert abs(fair.score(neutral[0]) - fair.score(neutral[1])) < 0.5 * abs(plain.score(neutral[0]) - plain.score(neutral[1]))
    assert fair.score("zarbo awful zarbo people") > 0.5 > fair.score(neutral[0])


def test_the_penalty_acts_on_the_sums_that_make_the_score():
    """The words' weights given, a larger penalty lowers what a swap changes in the score itself."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(1, 1, (400, 7)))
    y = (x[:, 1] + x[:, 3] > 2).astype(float)
    change = rng.normal(0, 1, (200, 7)) * np.array([0, 3, 0.1, 0.1, 0.1, 0.1, 0])
    moved = [np.abs(change @ toxicity._monotone(x, y, change, k)).mean() for k in (0.0, 10.0)]
    assert moved[1] < 0.5 * moved[0]


def test_swaps_reach_every_term_and_every_language():
    doc = "the women and the muslim women met Frauen".lower().split()
    got = toxicity.swaps(doc)
    assert len(got) == 4 + 5 + 3 and all(len(a) == len(b) == len(doc) for a, b in got)
    ((a, b),) = toxicity.swaps(["no", "group"], mention=5)
    assert a[:2] == b[:2] == ["no", "group"] and a[2] != b[2] and any(a[2] in k and b[2] in k for k in toxicity.IDENTITY_TERMS)


def test_scores_equal_a_plain_reading(data):
    rows, labels = data
    model = toxicity.train([t for _, t, _ in rows], [t for _, _, t in labels], epochs=3)

    def plain(text):
        from collections import Counter

        counts = Counter((text or "").lower().split())
        s = [(model.word(w), n) for w, n in counts.items()]
        total, high = sum(counts.values()), sorted((x for x, _ in s if x > 0), reverse=True)
        up = sum(x * min(n, 3) for x, n in s if x > 0)
        e = [1, high[0] if high else 0, sum(high[:3]) / 3, up / np.sqrt(total + 20), up / (total + 20) * 10, sum(x * n for x, n in s) / max(total, 1), np.log1p(total) / 5]
        return 1 / (1 + np.exp(-np.clip(np.dot(e, model.top), -30, 30)))

    texts = [t for _, t, _ in rows + ODD]
    assert np.allclose(model.scores(texts), [plain(t) for t in texts]) and len(model.scores([])) == 0
    assert np.allclose(model.scores(texts[::-1]), model.scores(texts)[::-1])


def test_labelled_sample_counts_rows_and_characters(spark):
    rows = [(i, "w" * (10 + i), None) for i in range(40)] + [(7, "again", None)] * 30 + [(8, "z" * 200_000, None), (9, None, None)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], LABELS)
    docs = docs_of(spark, rows)
    wanted = [i for i in range(40) if common.fold_of(i, 5)]
    full = toxicity.sample_labelled(docs, labels, "toxic")
    assert len(full) == sum(i in wanted for i, _, _ in rows) and ("z" * 200_000 in [t for t, _ in full]) == (8 in wanted)
    assert len(toxicity.sample_labelled(docs, labels, "toxic", sample=20)) <= 20
    few = toxicity.sample_labelled(docs, labels, "toxic", sample_chars=100)
    assert few and sum(len(t or "") for t, _ in few) <= 100


def test_stage_drops_toxic_rows_only(spark, tmp_path, data):
    rows, labels = data
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = docs_of(spark, rows + [(9_999, None, None)])
    out = toxicity.toxicity_stage(spark, docs, str(tmp_path))
    kept, want = {r.doc_id for r in out.collect()}, {i: t for i, _, t in labels}
    assert out.columns == docs.columns and 9_999 in kept
    assert np.mean([(i not in kept) == bool(t) for i, t in want.items()]) > 0.97


def test_language_pieces_come_from_anywhere_in_the_texts(spark):
    docs = spark.createDataFrame([(i, "header " * 200 + "body " * 800, "xx") for i in range(40)], "doc_id long, text string, lang string")
    text = langid.fit(docs)["xx"]
    assert text.count("body") > text.count("header") > 0
