"""Toxicity: a linear classifier over words and their beginnings, regularised by counterfactual swaps.

Features of a document are its distinct words (lower case, outer punctuation off) and the words'
beginnings of 3 to 8 letters, each with how often it occurs. Labelled sentences that name a group are
paired with themselves after a swap of the identity term for each other of its kind; a sentence that
names none is given a mention first, which is then swapped. The loss adds ``swap_penalty`` times the square of
the change in score, both where words get their weights and where a document's sums become its
score, so a group's name weighs what other names weigh and neutral mentions aren't marked.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, lean, materialize, small_batches, table

#: Identity terms by kind and language; a swap stays inside a kind. A parameter of the fit.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("gais", "lesbiennes", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
)
_OUTER = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…–—¡¿"
#: Words whose scores a worker remembers; texts repeat their frequent ones.
REMEMBERED = 100_000


def words(text: str | None) -> list[str]:
    """White-space words of the whole text, lower case."""
    return (text or "").lower().split()


def grams(word: str) -> list[str]:
    w = word.strip(_OUTER)
    return [f"={w}", *(w[:n] for n in range(3, min(8, len(w)) + 1))] if w else []


_ODD = np.random.default_rng(11).integers(1 << 62, 1 << 63, 9, dtype=np.uint64) | np.uint64(1)


def _beginnings(names: list[str]) -> np.ndarray:
    """64-bit hashes, never 0, of each name's first 1 to 8 letters; past its end they mean nothing."""
    letters = np.array(names, "U8").view(np.uint32).reshape(len(names), 8).astype(np.uint64)
    h = np.cumsum((letters + np.uint64(1)) * _ODD[:8], axis=1, dtype=np.uint64) + np.arange(1, 9, dtype=np.uint64) * _ODD[8]
    h = (h ^ (h >> np.uint64(29))) * _ODD[7]
    return (h ^ (h >> np.uint64(32))) | np.uint64(1 << 63)


class Model:
    """Weights by feature and the calibration of a document's sums. Plain data, so it travels to the executors."""

    def __init__(self, weights: dict[str, float], top: np.ndarray):
        self.weights, self.top = weights, top
        self._slots: dict[str, int] = {}
        self._scores = np.zeros(0)
        self._table: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"_slots": {}, "_scores": np.zeros(0), "_table": None}

    def word(self, w: str) -> float:
        """Sum of the weights of the word's ``grams``."""
        w, get = w.strip(_OUTER), self.weights.get
        s = get("=" + w, 0.0)
        for n in range(3, min(8, len(w)) + 1):
            s += get(w[:n], 0.0)
        return s

    def _words(self, new: list[str]) -> np.ndarray:
        """``word`` of many: weights of beginnings from an open hash table, all words and lengths at once."""
        if self._table is None:
            names = [g for g in self.weights if g[0] != "=" and 3 <= len(g) <= 8]
            whole = {g[1:]: x for g, x in self.weights.items() if g[0] == "="}
            size = 1 << max(10, (4 * len(names)).bit_length())
            keys, values = np.zeros(size, np.uint64), np.zeros(size)
            for g, h in zip(names, _beginnings(names)[np.arange(len(names)), [len(g) - 1 for g in names]].tolist() if names else [], strict=True):
                at = h & (size - 1)
                while keys[at]:
                    at = (at + 1) & (size - 1)
                keys[at], values[at] = h, self.weights[g]
            self._table = whole, keys, values
        whole, keys, values = self._table
        bare = [w.strip(_OUTER) for w in new]
        out = np.fromiter((whole.get(w, 0.0) for w in bare), np.float64, len(bare))
        hashes, length = _beginnings(bare), np.fromiter(map(len, bare), np.int64, len(bare))
        for n in range(3, 9):
            row = np.nonzero(length >= n)[0]
            h = hashes[row, n - 1]
            at = (h & np.uint64(len(keys) - 1)).astype(np.int64)
            while len(row):
                found = keys[at] == h
                out[row[found]] += values[at[found]]
                on = ~found & (keys[at] != 0)
                row, h, at = row[on], h[on], (at[on] + 1) & (len(keys) - 1)
        return out

    def _look_up(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each word and the slots' scores; each different word is scored once."""
        new = set(flat).difference(self._slots)
        if self._slots and len(self._slots) + len(new) > REMEMBERED:
            self._slots, self._scores, new = {}, np.zeros(0), set(flat)
        if new:
            at = len(self._slots)
            self._slots.update(zip(new, range(at, at + len(new)), strict=True))
            self._scores = np.concatenate((self._scores, self._words(list(new))))
        return np.fromiter(map(self._slots.__getitem__, flat), np.int64, len(flat)), self._scores

    def evidence(self, docs: list[list[str]]) -> np.ndarray:
        """Sums of each document: greatest word, mean of the three greatest, positive words over root and count of all, mean, length."""
        n = len(docs)
        total = np.fromiter(map(len, docs), np.float64, n)
        slots, scores = self._look_up(list(chain.from_iterable(docs)))
        doc = np.repeat(np.arange(n), total.astype(np.int64))
        x = scores[slots]
        mean = np.bincount(doc, x, n) / np.maximum(total, 1)
        good = x > 0
        width = max(1, len(scores))
        key, times = np.unique(doc[good] * width + slots[good], return_counts=True)
        doc, x = key // width, scores[key % width]
        up = np.bincount(doc, x * np.minimum(times, 3), n)
        order = np.lexsort((-x, doc))
        doc, x = doc[order], x[order]
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        first = np.bincount(doc[place == 0], x[place == 0], n)
        three = np.bincount(doc[place < 3], x[place < 3], n) / 3
        return np.stack([np.ones(n), first, three, up / np.sqrt(total + 20.0), up / (total + 20.0) * 10, mean, np.log1p(total) / 5], axis=1)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Of whole texts, in parts of bounded length."""
        out, part, size = [np.zeros(0)], [], 0
        for t in chain(texts, [None]):
            if part and (size > 1 << 20 or len(part) >= 256):
                out.append(self._logistic(part))
                part, size = [], 0
            part.append(words(t))
            size += len(t or "")
        out.append(self._logistic(part)[:-1])  # the one that closes the last part is no text
        return np.concatenate(out)

    def _logistic(self, part: list[list[str]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(part) @ self.top, -30, 30)))

    def score(self, text: str | None) -> float:
        return float(self.scores([text])[0])


def swaps(doc: list[str], terms=IDENTITY_TERMS, mention: int = 0) -> list[tuple[list[str], list[str]]]:
    """The sentence beside itself with an identity term swapped, for each term in it and each other of its kind.

    One that names no group is given a mention, chosen by the number ``mention``, and that is swapped for the next of its kind.
    """
    kind_of = {w: k for k in terms for w in k}
    out = []
    for w in sorted({w for w in doc if w.strip(_OUTER) in kind_of}):
        own = w.strip(_OUTER)
        out += [(doc, [other if v == w else v for v in doc]) for other in kind_of[own] if other != own]
    if not out and terms:
        kind = terms[mention % len(terms)]
        k = mention // len(terms) % len(kind)
        out = [([*doc, kind[k]], [*doc, kind[(k + 1) % len(kind)]])] if len(kind) > 1 else []
    return out


class _Rows:
    """Sparse rows, one after the other; several rows at once by their numbers."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.n = np.array([len(k) for k, _ in rows], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.cols, self.vals = np.empty(self.at[-1], np.int32), np.empty(self.at[-1], np.float32)
        for (k, x), a, b in zip(rows, self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            self.cols[a:b], self.vals[a:b] = k, x

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.n[which]
        row = np.repeat(np.arange(len(which)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.at[which], n)
        return row, self.cols[at], self.vals[at]


class _Features:
    """Numbers of words and of their grams, as they are met; a document's grams with their counts."""

    def __init__(self):
        self.of_word: dict[str, np.ndarray] = {}
        self.number: dict[str, int] = {}

    def _word(self, w: str) -> np.ndarray:
        ids = self.of_word.get(w)
        if ids is None:
            ids = self.of_word[w] = np.array([self.number.setdefault(g, len(self.number)) for g in grams(w)], np.int32)
        return ids

    def counts(self, doc: list[str]) -> tuple[np.ndarray, np.ndarray]:
        times = Counter(doc)
        ids = [self._word(w) for w in times]
        n = np.repeat(np.minimum(np.fromiter(times.values(), np.int64, len(times)), 3), np.fromiter(map(len, ids), np.int64, len(ids)))
        k, at = np.unique(np.concatenate([np.zeros(0, np.int32), *ids]), return_inverse=True)
        return k, np.bincount(at, n, len(k)).astype(np.int16)


def train(texts: list[str | None], labels: list[int], swap_penalty: float = 1.0, epochs: int = 12, min_docs: int = 4, decay: float = 3e-4, terms=IDENTITY_TERMS, seed: int = 0) -> Model:
    """Fit by mini-batch Adam. Features in fewer than ``min_docs`` documents of the sample are left out; all swaps count, averaged for each document."""
    seen: dict[str, str] = {}
    docs, features = [[seen.setdefault(w, w) for w in words(t)] for t in texts], _Features()
    del seen
    counts = [features.counts(d) for d in docs]
    for k in terms:
        features.counts(list(k))
    df = np.zeros(len(features.number), np.int32)
    for k, _ in counts:
        df[k] += 1
    keep = df >= min_docs
    keep[features.counts([w for k in terms for w in k])[0]] = True
    names = [g for g, kept in zip(features.number, keep.tolist(), strict=True) if kept]
    index = (np.cumsum(keep) - 1).astype(np.int32)
    y = np.array(labels, np.float64)

    def row(k: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        known = np.nonzero(k < len(keep))[0]
        known = known[keep[k[known]]]
        return index[k[known]], (np.log1p(n[known], dtype=np.float32) * (5 / np.sqrt(20.0 + length))).astype(np.float32)

    def change(own: tuple, other: tuple) -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate((own[0], other[0])), return_inverse=True)
        x = np.bincount(at, np.concatenate((own[1], -other[1])), len(k))
        return k[x != 0], x[x != 0]

    def mention(i: int, term: str) -> tuple[np.ndarray, np.ndarray]:
        """The document's counts of the term's own features."""
        k, n = counts[i]
        ids = np.sort(features.counts([term])[0])
        at = np.minimum(np.searchsorted(k, ids), max(len(k) - 1, 0))
        had = np.where(k[at] == ids, n[at], 0) if len(k) else np.zeros(len(ids))
        return ids, had

    rows, pairs, owner, share = [], [], [], []
    for i, d in enumerate(docs):
        rows.append(row(*counts[i], len(d)))
        found = swaps(d, terms, i)
        for own, other in found:
            if own is d:
                pairs.append(change(rows[i], row(*features.counts(other), len(other))))
            else:  # the rest of the sentence is alike on both sides
                (ka, na), (kb, nb) = mention(i, own[-1]), mention(i, other[-1])
                one, two = np.isin(ka, kb), np.isin(kb, ka)
                pairs.append(change(change(row(ka[~one], na[~one] + 1, len(own)), row(ka[~one], na[~one], len(own))), change(row(kb[~two], nb[~two] + 1, len(own)), row(kb[~two], nb[~two], len(own)))))
            owner.append(i)
            share.append(1 / len(found))
        counts[i] = None
    del counts, features
    data, pairs, owner, share = _Rows(rows), _Rows(pairs), np.array(owner, np.int64), np.array(share)
    del rows
    first = np.searchsorted(owner, np.arange(len(docs) + 1))

    rng, n = np.random.default_rng(seed), len(names)
    w, b, m, v, t = np.zeros(n), 0.0, np.zeros(n), np.zeros(n), 0
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) if len(y) else y
    held = np.arange(len(y)) % 4 == 3 if len(y) >= 200 else np.zeros(len(y), bool)  # the words' weights never see it; it calibrates their sums
    for _ in range(epochs if len(y) else 0):
        order = rng.permutation(np.nonzero(~held)[0])
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            rows, k, x = data.take(part)
            err = (1 / (1 + np.exp(-np.clip(np.bincount(rows, x * w[k], len(part)) + b, -30, 30))) - y[part]) * weight[part]
            g = np.bincount(k, x * err[rows], n)
            which = np.concatenate([np.zeros(0, np.int64), *(np.arange(first[i], first[i + 1]) for i in part)])
            rows, k, x = pairs.take(which)
            moved = np.bincount(rows, x * w[k], len(which)) * share[which]
            g += swap_penalty * 2 * np.bincount(k, x * moved[rows], n)
            g, gb, t = g / len(part) + decay * w, err.mean(), t + 1
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
            b -= 0.05 * gb
    model = Model({names[i]: float(w[i]) for i in np.nonzero(np.abs(w) > 0.02)[0]}, np.zeros(7))
    del data, pairs, names
    if len(y):
        fitted = np.nonzero(held)[0] if held.any() else np.arange(len(y))
        moved, parts = np.zeros((0, 7)), [range(k, min(k + 256, len(docs))) for k in range(0, len(docs), 256)]
        for part in parts:
            both = [p for i in part for p in swaps(docs[i], terms, i)]
            if both:
                moved = np.concatenate((moved, model.evidence([p[0] for p in both]) - model.evidence([p[1] for p in both])))
        moved *= np.sqrt(share)[:, None]
        x = np.concatenate([model.evidence([docs[i] for i in fitted[k : k + 256]]) for k in range(0, len(fitted), 256)])
        model.top = _monotone(x, y[fitted], moved, swap_penalty)
        model.__dict__.update(model.__getstate__())  # what training looked up isn't kept
    return model


def _monotone(x: np.ndarray, y: np.ndarray, change: np.ndarray, swap_penalty: float, ridge: float = 1e-3, rounds: int = 3000) -> np.ndarray:
    """Logistic regression by accelerated projected gradient: no kind of evidence may lower the score, and length may not raise it.

    ``change`` has the evidence's changes under swaps; the loss adds ``swap_penalty`` times the mean square of what they change.
    """
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-6)
    z, n = x / scale, len(y)
    swapped = change / scale
    swapped = 2 * swap_penalty * swapped.T @ swapped / max(1, len(change)) + ridge * np.eye(x.shape[1])
    low, high = np.array([-np.inf, *[0.0] * (x.shape[1] - 2), -np.inf]), np.array([*[np.inf] * (x.shape[1] - 1), 0.0])
    rate = 1 / max(np.linalg.norm(z, 2) ** 2 / n / 4 + np.linalg.norm(swapped, 2), 1e-9)
    a = b = np.zeros(x.shape[1])
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        new = np.clip(b - rate * (z.T @ (p - y) / n + swapped @ b), low, high)
        b, a = new + t / (t + 3) * (new - a), new
    return a / scale


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        h = (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x + ridge * np.eye(len(a))
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * a)
        a += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return a


def sample_labelled(docs: DataFrame, labels: DataFrame, target: str, folds: int = 5, held_out: int = 0, sample: int = 4000, sample_chars: int = 1 << 26) -> list[tuple]:
    """``(text, label)`` of at most ``sample`` labelled rows outside the held-out fold, first by hash of the id, of ``sample_chars`` characters in all.

    These bounds are for fitting only; a row that doesn't fit in what is left of the characters is passed over. Ids come
    first, so that only the sample's texts leave the scan; of rows that share an id each counts.
    """
    ids = labels.where(F.col(target).isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.min(target).alias("y"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(materialize(picked, "labelled")), "doc_id")
    rows = rows.select("doc_id", "y", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    rows = materialize(rows, "labelled-texts")
    left, keep = sample_chars, []
    for r in rows.select("h", "doc_id", "t", "n").orderBy("h", "doc_id", "t").limit(sample).collect():
        if r.n <= left:
            left -= r.n
            keep.append((r.doc_id, r.t))
    chosen = docs.sparkSession.createDataFrame(keep, "doc_id long, t long").groupBy("doc_id", "t").agg(F.count("*").alias("times"))
    found = rows.dropDuplicates(["doc_id", "t"]).join(F.broadcast(chosen), ["doc_id", "t"]).select("doc_id", "text", "y", "times").collect()
    return [(r.text, int(r.y)) for r in sorted(found, key=lambda r: (r.doc_id, r.text or "")) for _ in range(r.times)]


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of every row's whole text, however long; null counts as empty and gets the score of no evidence.

    Rows are independent: repeated rows come out as often, an empty table gives none, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    box = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(box.value.scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(run), "doc_id long, score double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, swap_penalty: float = 1.0, terms=IDENTITY_TERMS) -> Model:
    """Classifier from at most ``sample`` labelled documents; with no labels every score is 0.5."""
    rows = sample_labelled(docs, labels, "toxic", sample=sample)
    model = train([t for t, _ in rows], [y for _, y in rows], swap_penalty, terms=terms)
    del rows
    give_back()
    return model


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scores = toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scores.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go; the columns stay, and so do empty texts unless no evidence is a reason."""
    small_batches(spark)
    model = spark.sparkContext.broadcast(fit(docs, table(spark, sf_dir, "labels")))
    names = docs.columns

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.value.scores(b.column(names.index("text")).to_pylist()) < 0.5, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
