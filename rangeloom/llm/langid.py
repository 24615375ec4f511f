"""Language identification by cross-parsing against suffix automata.

A text is parsed greedily into the longest phrases that occur in a language's labelled text; a suffix
automaton of that text gives each phrase by walking one transition per letter. The language that
needs the fewest phrases per letter wins (the fewer, the smaller the cross entropy estimate).

Texts are cut in segments of ``SEGMENT`` letters, all parsed, each from the automaton's root, so that many
segments and all languages advance in step as numpy arrays; a cut adds one phrase at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, materialize, small_batches, table

SEGMENT = 1024
LANES = 1 << 15
_LETTERS = np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text; every run of anything but letters is one 32. Empty if there is no letter."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    known = _LETTERS[cp]
    if not known.any():
        return np.zeros(0, np.uint32)
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first of each run that isn't letters
    keep[0] = True
    return np.where(known, cp, 32)[keep]


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton of ``codes``; state 0 is the root."""
    goto: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in goto[p]:
            goto[p][c] = cur
            p = link[p]
        if p >= 0:
            q = goto[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(goto)
                goto.append(dict(goto[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and goto[p].get(c) == q:
                    goto[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return goto


class Parser:
    """All languages' automata in one table: entry = 2 * (offset of the next state) + (1 if a phrase begins here)."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        cleaned = [letters(texts[k]) for k in self.langs]
        symbols = np.unique(np.concatenate([*cleaned, [32]]))
        self.index = np.full(0x110000, len(symbols), np.int32)  # unseen letters share the last symbol, which no state has
        self.index[symbols] = np.arange(len(symbols))
        self.width = width = len(symbols) + 1
        tables, self.starts, at = [], [], 0
        for c in cleaned:
            goto = suffix_automaton(self._codes(c).tolist())
            dead = len(goto)  # after a letter that the language doesn't have, and before the first
            to = np.full((dead + 1, width), -1, np.int64)
            for s, g in enumerate(goto):
                to[s, list(g.keys())] = list(g.values())
            again = np.where(to[0] >= 0, to[0], dead)
            tables.append(np.where(to >= 0, 2 * (to + at) * width, 2 * (again + at)[None, :] * width + 1).astype(np.int32).ravel())
            self.starts.append((at + dead) * width)
            at += dead + 1
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        self.lengths = np.array([max(len(c), 2) for c in cleaned])

    def _codes(self, cp: np.ndarray) -> np.ndarray:
        return self.index[cp]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each text (from ``letters``) needs in each language."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        parts = [(i, self._codes(t[k : k + SEGMENT])) for i, t in enumerate(texts) for k in range(0, len(t), SEGMENT)]
        parts.sort(key=lambda p: -len(p[1]))
        per = max(1, LANES // max(1, len(self.langs)))
        for at in range(0, len(parts), per):
            self._lanes(parts[at : at + per], out)
        return out

    def _lanes(self, parts: list, out: np.ndarray) -> None:
        sizes = np.array([len(c) for _, c in parts])
        grid = np.zeros((sizes[0], len(parts)), np.int32)
        for j, (_, c) in enumerate(parts):
            grid[: len(c), j] = c
        live = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # lanes still running at each step
        states = np.repeat(np.array(self.starts, np.int32)[:, None], len(parts), axis=1)
        found = np.zeros(states.shape, np.int32)
        for row, n in zip(grid, live.tolist(), strict=True):
            v = self.table.take(states[:, :n] + row[:n])
            found[:, :n] += v & 1
            states[:, :n] = v >> 1
        np.add.at(out, [i for i, _ in parts], found.T)

    def bits(self, texts: list[str | None]) -> np.ndarray:
        """Code length of each text in each language: its phrases, weighed by what it takes to name one. Not a number if a text has no letter."""
        cps = [letters(t) for t in texts]
        out = self.phrases(cps) * np.log2(self.lengths)
        out[[not len(cp) for cp in cps]] = np.nan
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score, see ``best``."""
        least, which, weight = best(None, self.bits(texts), self.langs)
        return [(k, s) if k else ("und", 0.0) for k, s in zip(which, (1 / weight).tolist(), strict=True)]


def best(so_far: tuple | None, bits: np.ndarray, langs: list[str]) -> tuple[np.ndarray, list, np.ndarray]:
    """Of languages in order of name, seen in one go or group by group: least code length, its language, and the sum of all weights with the least one's as 1.

    The score is 1 over that sum. Ties go to the first by name; a text without letters has no language.
    """
    if so_far is None:
        so_far = np.full(len(bits), np.inf), [None] * len(bits), np.zeros(len(bits))
    least, which, weight = so_far
    if not bits.shape[1] or not len(bits):
        return so_far
    k = np.argmin(bits, axis=1)
    found = bits[np.arange(len(bits)), k]
    better = found < least
    now = np.where(better, found, least)
    with np.errstate(invalid="ignore"):
        old = np.where(np.isfinite(least), weight * np.exp2(np.maximum((now - least) * 0.25, -60)), 0)
        new = np.exp2(np.maximum((now[:, None] - bits) * 0.25, -60)).sum(axis=1)
    return now, [langs[j] if b else w for j, b, w in zip(k.tolist(), better.tolist(), which, strict=True)], np.where(np.isnan(found), 1.0, old + new)


_built: dict[int, Parser] = {}


def parser_of(texts: dict[str, str]) -> Parser:
    """The parser of a model, built once in each worker process: only the labelled text travels."""
    key = hash(tuple(sorted(texts.items())))
    if key not in _built:
        _built.clear()
        _built[key] = Parser(texts)
    return _built[key]


def fit(docs: DataFrame, folds: int = 4, held_out: int = 2, docs_per_lang: int = 150, chars_per_lang: int = 40_000) -> dict[str, str]:
    """Labelled text per language: pieces of ``docs_per_lang`` documents, first by hash of the id, ``chars_per_lang`` letters in all.

    A piece has 4 * ``chars_per_lang`` / ``docs_per_lang`` characters from a place in the text that a hash of the id gives, so that
    shared headers aren't what is learned. These bounds are for fitting only. A language with a single document is learned from that one.
    """
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "lang")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = materialize(ids.withColumn("n", first).where(F.col("n") <= docs_per_lang).select("doc_id", "lang").distinct(), "langid-ids")
    piece = 4 * chars_per_lang // docs_per_lang
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), (docs.doc_id.eqNullSafe(ids.doc_id)) & (docs.lang == ids.lang), "left_semi")
    start = (F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.length("text") - piece, F.lit(0)) + 1) + 1).cast("int")
    out: dict[str, str] = {}
    for r in sorted(rows.select("doc_id", "lang", F.substring(F.col("text"), start, F.lit(piece)).alias("t")).collect(), key=lambda r: (r.lang, r.doc_id or -1, r.t)):
        had = out.get(r.lang, "")
        out[r.lang] = had + r.t + " " if len(had) < chars_per_lang else had
    return {k: v[:chars_per_lang] for k, v in out.items() if len(letters(v))}


def language_of(docs: DataFrame, model: dict[str, str], text: str = "text", id_col: str = "doc_id", group: int = 100) -> DataFrame:
    """``doc_id, lang_pred, score`` of every row's whole text, however long; ``und`` and 0 if it is null or has no letter.

    A worker holds the automata of ``group`` languages. With more languages the texts are read once for each group, and
    the best so far goes with them from one stored table to the next; the result is the same. Repeated rows come
    out as often, an empty table gives none, other columns are ignored.
    """
    small_batches(docs.sparkSession)
    context, names = docs.sparkSession.sparkContext, sorted(model)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = [names[k : k + group] for k in range(0, len(names), group)] or [[]]

    def parsed(box, first: bool, last: bool):
        def run(batches):
            for b in batches:
                parser = parser_of(box.value)
                texts = b.column("text").to_pylist()
                had = None if first else (b.column("least").to_numpy(zero_copy_only=False), b.column("which").to_pylist(), b.column("weight").to_numpy(zero_copy_only=False))
                least, which, weight = best(had, parser.bits(texts) if parser.langs else np.zeros((len(texts), 0)), parser.langs)
                if last:
                    score = np.where([w is None for w in which], 0.0, 1 / np.maximum(weight, 1e-300))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([w or "und" for w in which], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
                else:
                    cols = [b.column("doc_id"), b.column("text"), pa.array(least, pa.float64()), pa.array(which, pa.string()), pa.array(weight, pa.float64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "least", "which", "weight"])

        return run

    for k, langs in enumerate(groups):
        box, last = context.broadcast({n: model[n] for n in langs}), k == len(groups) - 1
        rows = rows.mapInArrow(parsed(box, k == 0, last), "doc_id long, lang_pred string, score double" if last else "doc_id long, text string, least double, which string, weight double")
        rows = rows if last else materialize(rows, "langid-so-far")
    return rows


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language_of(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
