import random
import re

import numpy as np
import pytest
import xxhash

from rangeloom.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def plain_components(prints):
    root = {}
    for i, f in prints:
        root.setdefault(f, f)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(root)
    for i, x in enumerate(fps):
        for y in fps[i + 1 :]:
            if (x ^ y).bit_count() <= 3:
                root[find(x)] = find(y)
    first = {}
    for i, f in prints:
        if i is not None:
            first[find(f)] = min(i, first.get(find(f), i))
    return {(i, f, first.get(find(f))) for i, f in prints}


def flipped(rng, x, n):
    for b in rng.sample(range(64), n):
        x ^= 1 << b
    return x


def test_fingerprint_equals_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 700):
        text = "".join(rng.choice(["Ab", "É", "x", " ", "\t", " ", "\x0b", "\x1c", "ß "]) for _ in range(n * 3))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    long = " ".join(str(rng.randrange(50)) for _ in range(40_000))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_anchors_cover_and_every_close_half_visits_the_home():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 32, 4000)
    home, every = simhash.anchors(x)
    assert (np.bitwise_count((home ^ x).astype(np.uint64)) <= 1).all()
    assert (simhash._syndrome(home & 0x7FFFFFFF) == 0).all()
    for b in range(32):
        _, near = simhash.anchors(x ^ (1 << b))
        assert (near == home[:, None]).any(axis=1).all()
    assert (every == home[:, None]).any(axis=1).all()


@pytest.mark.parametrize("small", [256, 0])
def test_links_keep_the_classes_of_all_pairs(spark, small):
    rng = random.Random(2)
    seeds = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    fps = {flipped(rng, s, rng.randrange(6)) for s in seeds for _ in range(9)}
    crowd = rng.getrandbits(64)
    fps |= {flipped(rng, crowd, rng.randrange(5)) for _ in range(400)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(f), 0) for f in fps], "fp long, first long")
    got = simhash.links(df, small=small, slice_size=64)
    assert got.count() < 20 * len(fps)
    pairs = {(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in got.collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in pairs)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[find(a)] = find(b)
    ids = {f: i for i, f in enumerate(sorted(fps))}
    want = {f: c for i, f, c in plain_components([(ids[f], f) for f in fps])}
    least = {}
    for f in fps:
        least[find(f)] = min(ids[f], least.get(find(f), ids[f]))
    assert {f: least[find(f)] for f in fps} == want


def test_query_equals_all_pairs(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) + str(rng.randrange(40)) for _ in range(300)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for t in base[:6]:
        words = t.split()
        words[rng.randrange(300)] = "changed"
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, t)]
    rows += [(90, None), (91, ""), (92, " \t"), (93, "one"), (94, "One"), (None, base[0]), (None, "lonely text without an id"), (5, base[5])]
    got = simhash.near_groups(docs_of(spark, rows)).collect()
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got} == plain_components(prints)


def test_empty_table(spark):
    assert simhash.near_groups(docs_of(spark, [])).count() == 0


def test_stage_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(3, text), (1, text), (2, "other words stand here"), (None, "no id here at all")]
    out = simhash.simhash_stage(spark, docs_of(spark, rows), "")
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "None"]
    assert out.columns == docs_of(spark, []).columns


def jaccard(a, b):
    x, y = (set(simhash.shingles((t or "").encode()).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 0.0


def prose(rng, n):
    return [rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


#: As they are; and so that all that meets is a crowd.
LIMITS = [{}, {"hot": 2, "hot_again": 2, "per_member": 0, "pivots": 1}, {"hot": 10**9, "hot_again": 10**9, "per_member": 1, "pivots": 1}]


@pytest.mark.parametrize("limits", LIMITS)
def test_similar_groups_find_edited_copies_and_nothing_else(spark, limits):
    rng = random.Random(21)
    rows, copies, others = [], {}, set()
    for k in range(150):
        words = prose(rng, rng.randrange(120, 500))
        rows.append((k, " ".join(words)))
        edited = [rng.choice(words) if rng.random() < (0.01, 0.03)[k % 2] else w for w in words]
        rows.append((1000 + k, " ".join(edited)))
        if jaccard(rows[-2][1], rows[-1][1]) >= 0.8:
            copies[1000 + k] = k
        else:
            others.add(1000 + k)
    crowd = prose(rng, 400)
    for k in range(60):  # a crowd of copies of one text, each alike to it, fewer alike to each other
        rows.append((5000 + k, " ".join(rng.choice(crowd) if k and rng.random() < 0.012 else w for w in crowd)))
    rows += [(9000, None), (9001, ""), (9002, None), (9003, "a short one"), (9004, "A short  one"), (9005, "another short one"), (None, rows[0][1]), (None, "an id is missing here")]
    got = simhash.similar_groups(docs_of(spark, rows), **limits).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    hit = sum(by[c].first_id == k and not by[c].first for c, k in copies.items())
    assert len(copies) > 80 and hit >= 0.95 * len(copies)
    assert others and all(by[c].first for c in others)
    text = dict(rows)
    near = [k for k in range(5001, 5060) if jaccard(text[5000], text[k]) >= 0.8]
    assert len(near) > 40 and sum(by[k].first_id == 5000 for k in near) >= 0.95 * len(near)
    assert all(by[k].first for k in (9000, 9001, 9002, 9003, 9005)) and by[9004].first_id == 9003
    assert [r.first_id for r in got if r.doc_id is None and not r.first] == [0]


def test_similar_groups_of_empty_table(spark):
    assert simhash.similar_groups(docs_of(spark, [])).count() == 0


def groups_by_all_pairs(rows):
    """The smallest id of each row's group, by the similarity of all pairs."""
    grams = {i: set(simhash.shingles((t or "").encode()).tolist()) for i, t in rows}
    root = {i: i for i in grams}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in grams:
        for j in grams:
            if i < j and grams[i] and 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j]) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in grams}


@pytest.mark.parametrize("limits", LIMITS)
def test_similar_groups_of_a_crowd_equal_all_pairs(spark, limits):
    """Copies at 0.8 or more to their original but not to each other, originals beside each other, in one crowd."""
    rng = random.Random(5)
    shared, rows = prose(rng, 150), []
    for k in range(8):
        words = shared + prose(rng, 60)
        rows.append((len(rows) + 1000 * (k % 2), " ".join(words)))
        for _ in range(12):
            copy = list(words)
            for at in rng.sample(range(len(words)), 4):
                copy[at] = prose(rng, 1)[0] + "x"
            rows.append((len(rows) + 1000 * (k % 2), " ".join(copy)))
    want = groups_by_all_pairs(rows)
    assert 8 <= len(set(want.values())) < 60
    got = simhash.similar_groups(docs_of(spark, rows), **limits).collect()
    assert {r.doc_id: r.first_id for r in got} == want


def test_similar_groups_find_every_block_added(spark):
    rng = random.Random(6)
    rows = []
    for k in range(240):
        words = prose(rng, rng.randrange(100, 400))
        most = int(len(words) * (0.1, 0.15, 0.2, 0.24)[k % 4])
        block = ["n" + w for w in prose(rng, most)]
        rows += [(k, " ".join(words)), (1000 + k, " ".join(block + words if k % 2 else words + block))]
    copies = [k for k in range(240) if jaccard(rows[2 * k][1], rows[2 * k + 1][1]) >= 0.8]
    got = {r.doc_id: r.first_id for r in simhash.similar_groups(docs_of(spark, rows)).collect()}
    assert len(copies) > 200 and all(got[1000 + k] == k for k in copies)
    assert got == groups_by_all_pairs(rows)


@pytest.mark.parametrize("lead", range(4))
def test_texts_of_the_same_words_keep_their_other_links(spark, lead):
    """A has B's lines in another order; B' and C are near copies of B. None depends on which has the least hash."""
    rng = random.Random(8 + lead)
    lines = [" ".join(prose(rng, 4)) for _ in range(60)]
    a, b = rng.sample(lines, 60), list(lines)
    swapped, longer = " ".join(b).split(), " ".join(b) + " anew"
    swapped[100] = next(w for w in swapped if swapped.count(w) > 1 and w != swapped[100])
    texts = {1: " ".join(a), 2: " ".join(b), 3: " ".join(swapped), 4: longer}
    rows = [*texts.items(), *((100 + n, " ".join(rng.sample(lines, 60))) for n in range(20))]
    want = groups_by_all_pairs(rows)
    assert want[2] == want[3] == want[4] == 2 and want[1] == 1
    assert {r.doc_id: r.first_id for r in simhash.similar_groups(docs_of(spark, rows)).collect()} == want


def test_stage_takes_its_first_candidates_from_simhash(spark, monkeypatch):
    rng = random.Random(9)
    words = prose(rng, 400)
    texts = {1: " ".join(words), 2: " ".join([*words[:200], "anew", *words[201:]]), 3: " ".join(prose(rng, 300))}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert 0 < (prints[1] ^ prints[2]).bit_count() <= 3
    whole, mask, seen = simhash.links, (1 << 64) - 1, []

    def links(fps, *args):
        out = whole(fps, *args)
        seen.append(({r.fp & mask for r in fps.collect()}, {frozenset((r.a & mask, r.b & mask)) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "links", links)
    out = simhash.simhash_stage(spark, docs_of(spark, [*texts.items(), (4, "")]), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4]
    assert seen == [(set(prints.values()), {frozenset((prints[1], prints[2]))})]


def test_a_family_of_copies_is_not_searched_again(spark, monkeypatch):
    """All but two texts link to one of them: what is between the trees is compared, and no text is taken apart a second time."""
    rng = random.Random(10)
    words, rows = prose(rng, 400), []
    for k in range(42):
        changed = set(rng.sample(range(400), 30 if k > 39 else 4 if k else 0))
        rows.append((k, " ".join("x" + w if at in changed else w for at, w in enumerate(words))))
    want, counts, store = groups_by_all_pairs(rows), {}, simhash.materialize
    assert set(want.values()) == {0, 40, 41}

    def counted(df, name):
        out = store(df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    got = simhash.similar_groups(docs_of(spark, rows)).collect()
    assert {r.doc_id: r.first_id for r in got} == want
    assert counts["similar-again"] == 0
