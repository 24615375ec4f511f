"""Benchmark decontamination: BM25 over test items with block-max WAND, then question and answer overlap.

The index holds the test items; every passage of every document is a query. Impacts are divided by
the item's score for itself, so a score is the share of the item's weight that the passage has, and one threshold
serves all items. Passages are windows of two steps, a step being as long as the longest item, so
that any occurrence of an item lies whole in some window.

Before the WAND traversal, whole batches of documents pass a bound in numpy that loses nothing: of each
item the lightest terms, together ``slack`` at most, are left out, and a passage needs ``threshold - slack`` from
the others.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

K1, B = 1.2, 0.75
THRESHOLD = 0.5
OVERLAP = 0.5
NGRAM = 5
POSTINGS_PER_BLOCK = 32
#: Bytes that part words besides white space: all of ASCII but letters and digits.
_PARTING = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case (UTF-8), parted by white space and ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "replace").translate(_PARTING).split()


def parts(words: list[bytes], text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item: cut at the first question mark or, without one that leaves an answer, after two thirds."""
    if "?" in text:
        n = len(tokens(text[: text.index("?") + 1]))
        if 0 < n < len(words):
            return words[:n], words[n:]
    n = max(1, len(words) * 2 // 3)
    return words[:n], words[n:]


def ngrams(words: list[bytes], n: int = NGRAM) -> set[tuple]:
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


class Index:
    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = THRESHOLD, slack: float = 0.3, whole: tuple[int, int, int, dict[bytes, int]] | None = None):
        """``whole``: number of items, their words, the longest one's words and the items of each term, where these are a slice of more items."""
        items = sorted(((i, t or "") for i, t in items), key=lambda p: (p[0] is None, p[0] or 0, p[1]))
        bags = [tokens(t) for _, t in items]
        rows = [k for k, b in enumerate(bags) if b]
        self.ids = [items[k][0] for k in rows]
        self.bags = [bags[k] for k in rows]
        self.parts = [parts(bags[k], items[k][1]) for k in rows]
        self.threshold = threshold
        sizes = list(map(len, self.bags))
        n, total, longest, df = whole or (len(rows), sum(sizes), max(sizes, default=0), Counter(t for b in self.bags for t in set(b)))
        self.step = max(32, longest)
        self.terms = {t: k for k, t in enumerate(sorted({t for b in self.bags for t in b}))}
        mean = total / max(n, 1)
        postings: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        heavy: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        for i, b in enumerate(self.bags):
            raw = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(b) / mean)) for t, f in Counter(b).items()}
            whole, left = sum(raw.values()), slack
            for t, x in sorted(raw.items(), key=lambda p: (p[1], p[0])):
                x /= whole
                postings[self.terms[t]].append((i, x))
                left -= x
                if left < 0:
                    heavy[self.terms[t]].append((i, x))
        self.lists = []
        for p in postings:
            at, x = [i for i, _ in p], [v for _, v in p]
            blocks = range(0, len(p), POSTINGS_PER_BLOCK)
            self.lists.append((at, x, [at[min(k + POSTINGS_PER_BLOCK, len(at)) - 1] for k in blocks], [max(x[k : k + POSTINGS_PER_BLOCK]) for k in blocks], max(x)))
        self.bound = threshold - slack
        self.heavy_at = np.concatenate(([0], np.cumsum([len(h) for h in heavy]))).astype(np.int64)
        self.is_heavy = np.array([bool(h) for h in heavy] + [False])  # the last is for -1
        self.heavy_item = np.array([i for h in heavy for i, _ in h], np.int64)
        self.heavy_impact = np.array([x for h in heavy for _, x in h])

    def numbers(self, text: str | None) -> np.ndarray:
        """Term number of each word of ``tokens(text)``, -1 for those not in the index."""
        words = tokens(text)
        return np.fromiter(map(self.terms.get, words, repeat(-1)), np.int64, len(words))

    def wand(self, terms: set[int]) -> list[tuple[int, float]]:
        """All items whose score for a passage of these terms reaches the threshold, by block-max WAND."""
        lists = [self.lists[t] for t in sorted(terms)]
        cur, blk = [0] * len(lists), [0] * len(lists)
        live, out, theta = list(range(len(lists))), [], self.threshold - 1e-12

        def forward(k, item):
            at, _, last, _, _ = lists[k]
            b = blk[k]
            while b < len(last) and last[b] < item:
                b += 1
            if b > blk[k]:
                blk[k], cur[k] = b, b * POSTINGS_PER_BLOCK
            c = cur[k]
            while c < len(at) and at[c] < item:
                c += 1
            cur[k] = c

        while True:
            live = [k for k in live if cur[k] < len(lists[k][0])]
            live.sort(key=lambda k: lists[k][0][cur[k]])
            total, pivot = 0.0, -1
            for j, k in enumerate(live):
                total += lists[k][4]
                if total >= theta:
                    pivot = j
                    break
            if pivot < 0:
                return out
            item = lists[live[pivot]][0][cur[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][cur[live[pivot + 1]]] == item:
                pivot += 1
            bound, jump = 0.0, math.inf
            for k in live[: pivot + 1]:
                _, _, last, peak, _ = lists[k]
                b = blk[k]
                while b < len(last) and last[b] < item:
                    b += 1
                if b < len(last):
                    bound += peak[b]
                    jump = min(jump, last[b] + 1)
            if bound < theta:  # nothing in these blocks can do it: on to the next block, or the next list's item
                if pivot + 1 < len(live):
                    jump = min(jump, lists[live[pivot + 1]][0][cur[live[pivot + 1]]])
                for k in live[: pivot + 1]:
                    forward(k, max(jump, item + 1))
                continue
            for k in live[: pivot + 1]:
                forward(k, item)
            score = 0.0
            for k in live[: pivot + 1]:
                at, x, _, _, _ = lists[k]
                if cur[k] < len(at) and at[cur[k]] == item:
                    score += x[cur[k]]
                    cur[k] += 1
                    if cur[k] % POSTINGS_PER_BLOCK == 0:
                        blk[k] = cur[k] // POSTINGS_PER_BLOCK
            if score >= theta:
                out.append((item, score))

    def windows(self, docs: list[np.ndarray]) -> list[tuple[int, int]]:
        """(document, first step) of the passages that may reach the threshold for some item; none is missed."""
        if not self.ids:
            return []
        steps = np.array([-(-len(d) // self.step) for d in docs], np.int64)
        base = np.concatenate(([0], np.cumsum(steps + 2)))  # gaps, so neighbours never are of another document
        flat = np.concatenate([np.zeros(0, np.int64), *docs])
        size = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(len(docs)), size)
        within = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        hit = np.nonzero((flat >= 0) & self.is_heavy[flat])[0]
        # Each term once in a block of one step; a passage is two blocks, so its bound is the sum of two.
        pair = np.unique((base[owner[hit]] + 1 + within[hit] // self.step) * len(self.terms) + flat[hit])
        block, term = np.divmod(pair, len(self.terms))
        n = self.heavy_at[term + 1] - self.heavy_at[term]
        row = np.repeat(np.arange(len(term)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.heavy_at[term][row]
        key, back = np.unique(self.heavy_item[k] * base[-1] + block[row], return_inverse=True)
        got = np.bincount(back, self.heavy_impact[k], len(key))
        blocks = []
        for d in (0, 1):  # the passage that begins here, and the one that ends here
            total = got.copy()
            at = np.minimum(np.searchsorted(key, key + 1 - 2 * d), max(len(key) - 1, 0))
            ok = key[at] == key + 1 - 2 * d if len(key) else np.zeros(0, bool)
            total[ok] += got[at[ok]]
            blocks.append(key[total >= self.bound - 1e-9] % base[-1] - d)
        blocks = np.unique(np.concatenate(blocks))
        doc = np.searchsorted(base, blocks, side="right") - 1
        first = blocks - base[doc] - 1
        ok = (first >= 0) & (first < steps[np.minimum(doc, len(steps) - 1)])
        return list(zip(doc[ok].tolist(), first[ok].tolist(), strict=True))

    def matches(self, texts: list[str | None]) -> list[dict[int, tuple[int, float, float, float]]]:
        """Of each text: item row -> (word at which the best passage begins, score, question and answer overlap), verified ones only."""
        docs = [self.numbers(t) for t in texts]
        out: list[dict] = [{} for _ in texts]
        words: tuple[int, list[bytes]] = (-1, [])
        for d, first in self.windows(docs):
            lo = first * self.step
            ids = docs[d][lo : lo + 2 * self.step]
            found = self.wand(set(ids[ids >= 0].tolist()))
            if not found:
                continue
            if words[0] != d:
                words = (d, tokens(texts[d]))
            passage = words[1][lo : lo + 2 * self.step]
            grams: dict[int, set] = {}
            for item, score in found:
                shares = []
                for part in self.parts[item]:
                    n = min(NGRAM, len(part))
                    if n not in grams:
                        grams[n] = ngrams(passage, n) if n else set()
                    want = ngrams(part, n) if n else set()
                    shares.append(len(want & grams[n]) / len(want) if want else 1.0)
                if min(shares) >= OVERLAP:
                    new = (lo, score, *shares)
                    if item not in out[d] or (score, -lo) > (out[d][item][1], -out[d][item][0]):
                        out[d][item] = new
        return out


def _item_terms(batches):
    """Each item's different terms, with the item's number of words at the first of them and 0 at the others."""
    for b in batches:
        for k, text in zip(b.column("slice").to_pylist(), b.column("text").to_pylist(), strict=True):
            if bag := tokens(text):
                terms = sorted(set(bag))
                words = [len(bag)] + [0] * (len(terms) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(terms), pa.int32()), pa.array(terms, pa.binary()), pa.array(words, pa.int64())], ["slice", "term", "words"])


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD, max_bytes: int = 8 << 20) -> list[Index]:
    """Indexes over slices of the items, each of about ``max_bytes`` of text: what is broadcast at once stays bounded.

    Statistics are those of all items, whatever the slices: each gets the document frequencies of its own terms.
    """
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total // max_bytes))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)).cast("int"))
    if slices > 1:
        terms = materialize(rows.mapInArrow(_item_terms, "slice int, term binary, words long"), "decontam-terms")
        sums = terms.agg(F.count_if(F.col("words") > 0), F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.max("words"), F.lit(0))).first()
        df = materialize(terms.groupBy("term").agg(F.count("*").alias("n")), "decontam-df")
    out = []
    for k in range(slices):
        part, whole = rows.where(F.col("slice") == k).collect(), None
        if slices > 1:
            found = df.join(terms.where(F.col("slice") == k).select("term").distinct(), "term").toArrow()
            whole = (*sums, dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True)))
        out.append(Index([(r.item_id, r.text) for r in part], threshold, whole=whole))
    return out


def _batches(batch, column, step=250):
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, part.column(column).to_pylist()


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and test item it contains: ``doc_id, item_id, at_word, score, question_overlap, answer_overlap``.

    Null or empty texts and items without a word match nothing. An item without an id counts like any other and is reported with a null ``item_id``. Repeated documents and items
    each have their rows. Documents aren't shuffled; the index is broadcast, in slices of bounded size.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in indexes(benchmark, threshold):
        box = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, box=box):
            for b in batches:
                for part, texts in _batches(b, "text"):
                    found = [(i, box.value.ids[k], *m) for i, ms in zip(part.column("doc_id").to_pylist(), box.value.matches(texts), strict=True) for k, m in ms.items()]
                    cols = list(zip(*found, strict=True)) if found else [[]] * 6
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "at_word", "score", "question_overlap", "answer_overlap"])

        part = rows.mapInArrow(run, "doc_id long, item_id long, at_word long, score double, question_overlap double, answer_overlap double")
        out = part if out is None else out.union(part)
    return out


def op4_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that contain a test item go; the columns stay."""
    small_batches(spark)
    names, schema = docs.columns, docs.schema
    for index in indexes(table(spark, sf_dir, "benchmark")):
        box = spark.sparkContext.broadcast(index)

        def run(batches, box=box):
            for b in batches:
                for part, texts in _batches(b, names.index("text")):
                    yield part.filter(pa.array([not m for m in box.value.matches(texts)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
