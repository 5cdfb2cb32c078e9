"""Language identification, word first: known words score by their log frequency in each
language; an unseen word backs off to its character 5-grams, then 4-, 3-, 2- and 1-grams, until
one of them is known.

A word is a letter and the letters and combining marks that follow it, in lower case, framed by spaces for its
n-grams; a frame alone is no evidence. Scores are mean negative log10 frequencies over a text's known words, absent entries at
PENALTY; the lowest wins, ties to the language that sorts first. The confidence is the softmax over the languages of
the summed scores of MOST_EVIDENCE words at most.

The model is fitted on at most SAMPLE_DOCS labelled training rows, those whose id hashes
lowest among rows of at most SAMPLE_CHARS characters, so the fit is bounded and the same for any partitioning.
Prediction reads whole texts, in slices, in arrays: words and n-grams are hashed, and looked up by their hashes.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text with letters but without any known
word or n-gram (a script never seen) gets the language that sorts first with score 0; a null
doc_id is not held out and never a training row; without training rows all are ``und``; repeated rows each have a
result; of repeated ids one row is learned from; texts of any length are read whole; extra columns of any names are ignored, and pass through
``known_language``; an empty table gives no rows.
"""

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import chosen, documents, fold

SAMPLE_DOCS, SAMPLE_CHARS = 3000, 20_000
ORDERS, PENALTY, MOST_EVIDENCE = (5, 4, 3, 2, 1), 7.0, 20
FOLDS, HELD = 3, 1
LEAST_SCORE = 0.5

#: Characters of text handled at once; code points whose kind is in the table.
SLICE_CHARS, TOP = 1 << 19, 0x20000
OTHER, LETTER, MARK = 0, 1, 2
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_places = W.mix(np.arange(300, 305, dtype=U64)) | U64(1)
_made: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Whether a code point is a letter or a combining mark; all beyond TOP count as letters (rare ideographs)."""
    if not _made:
        category = [unicodedata.category(chr(c))[0] for c in range(TOP)]
        _made.append(np.array([LETTER if k == "L" else MARK if k == "M" else OTHER for k in category] + [LETTER], np.uint8))
    return _made[0]


def words(texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered texts in one; where words begin and end in it; the text of each."""
    lowered = [(t or "").lower() for t in texts]
    joined = "\n".join(lowered)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = kinds()[np.minimum(code, TOP)]
    inside = kind != OTHER
    before = np.append(False, inside[:-1])
    while (stray := inside & (kind == MARK) & ~before).any():  # marks that follow no letter
        inside &= ~stray
        before[1:] = inside[:-1]
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1
    return joined, begin, end, np.searchsorted(np.cumsum([len(t) + 1 for t in lowered]), begin, side="right")


def codes(joined: str, begin: np.ndarray, end: np.ndarray, frame: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' code points, mixed, one word after the other, with ``frame`` spaces before and after each; where each begins; its length."""
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    length = end - begin
    wide = length + 2 * frame
    first = np.cumsum(wide) - wide
    out = np.full(int(wide.sum()), ord(" "), U64)
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(first + frame, length) + place] = code[np.repeat(begin, length) + place]
    return W.mix(out + U64(1)), first, wide


def hashes(joined: str, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words."""
    own, first, length = codes(joined, begin, end)
    power = np.full(int(length.max()), _STEP, U64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    place = np.arange(len(own)) - np.repeat(first, length)
    return W.mix(np.add.reduceat(own * power[place], first) + length.astype(U64))


def gram_hashes(own: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of each n code points in a row."""
    m = max(0, len(own) - n + 1)
    total = np.full(m, U64(n))
    for k in range(n):
        total += own[k : k + m] * _places[k]
    return W.mix(total)


def grams(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [g for i in range(len(framed) - n + 1) if (g := framed[i : i + n]) != " "]


def _entry_hashes(entries: list[str], n: int) -> np.ndarray:
    length = np.array([len(e) for e in entries], np.int64)
    end = np.cumsum(length)
    return hashes("".join(entries), end - length, end) if n == 0 else gram_hashes(codes("".join(entries), end - length, end)[0], n)[:: n]


def fit(rows) -> dict:
    """The model of (text, lang) rows: languages, and by order (0: words) the entries' hashes, ascending, and each one's cost in every language."""
    counts: dict[int, dict[str, Counter]] = {n: {} for n in (0, *ORDERS)}
    for text, lang in rows:
        joined, begin, end, _ = words([text])
        counts[0].setdefault(lang, Counter()).update(joined[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True))
    languages = sorted(counts[0])
    for lang, seen in counts[0].items():
        for n in ORDERS:
            own = counts[n][lang] = Counter()
            for word, c in seen.items():
                for g in grams(word, n):
                    own[g] += c
    tables = {}
    for n, by_lang in counts.items():
        table: dict[str, list[float]] = {}
        for k, lang in enumerate(languages):
            total = sum(by_lang[lang].values())
            for entry, c in by_lang[lang].items():
                if c > 1:
                    table.setdefault(entry, [PENALTY] * len(languages))[k] = min(PENALTY, -math.log10(c / total))
        h = _entry_hashes(list(table), n) if table else np.zeros(0, U64)
        order = np.argsort(h)
        tables[n] = h[order], np.array(list(table.values())).reshape(len(table), len(languages))[order]
    return {"languages": languages, "tables": tables}


class Scorer:
    def __init__(self, model: dict):
        self.languages, self.tables = model["languages"], model["tables"]

    def found(self, n: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes have an entry of order n, and where."""
        known = self.tables[n][0]
        if not len(known):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return known[at] == h, at

    def looked_up(self, joined: str, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word its cost in every language and whether it has one: its own, or the mean of its longest n-grams that are known."""
        distinct, first, inverse = np.unique(hashes(joined, begin, end), return_index=True, return_inverse=True)
        costs = np.zeros((len(distinct), len(self.languages)))
        known, at = self.found(0, distinct)
        costs[known] = self.tables[0][1][at[known]]
        rest = np.flatnonzero(~known)
        for n in ORDERS:
            if not len(rest):
                break
            own, start, length = codes(joined, begin[first[rest]], end[first[rest]], 1)
            word = np.repeat(np.arange(len(rest)), length)
            h = gram_hashes(own, n)
            inside = np.arange(len(h)) + n <= (start + length)[word[: len(h)]]
            hit, at = self.found(n, h)
            hit &= inside
            word, at = word[: len(h)][hit], at[hit]
            many = np.bincount(word, minlength=len(rest))
            has = many > 0
            for lang in range(len(self.languages)):
                costs[rest[has], lang] = (np.bincount(word, self.tables[n][1][at, lang], len(rest)) / np.maximum(many, 1))[has]
            known[rest[has]] = True
            rest = rest[~has]
        return costs[inverse], known[inverse]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        while len(out) < len(texts):
            i = j = len(out)
            size = 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= SLICE_CHARS):
                size += len(texts[j] or "")
                j += 1
            out += self._slice(texts[i:j])
        return out

    def _slice(self, texts):
        n, total, every = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        joined, begin, end, text = words(texts)
        step = SLICE_CHARS // 4  # words of one very long text, a part at a time
        for k in range(0, len(begin), step):
            costs, known = self.looked_up(joined, begin[k : k + step], end[k : k + step])
            own = text[k : k + step]
            every += np.bincount(own, minlength=len(texts))
            n += np.bincount(own, known, len(texts))
            for lang in range(len(self.languages)):
                total[:, lang] += np.bincount(own, costs[:, lang], len(texts))
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmin(axis=1)
        lead = (mean[np.arange(len(best)), best][:, None] - mean) * (math.log(10) * np.minimum(n, MOST_EVIDENCE))[:, None]
        score = np.where(n > 0, 1 / np.exp(lead).sum(axis=1), 0.0)
        return [(self.languages[b], float(s)) if e else ("und", 0.0) for b, s, e in zip(best.tolist(), score, every, strict=True)]

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter((fold(F.col("doc_id"), FOLDS) != HELD) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= sample_chars))
    sample = chosen(rows, "doc_id", sample_docs).select("text", "lang").toArrow()
    return fit(zip(sample["text"].to_pylist(), sample["lang"].to_pylist(), strict=True))


def identified(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            found = scorer.predict_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id").cast("long"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def known_language(docs: DataFrame, model: dict, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs without those of no language or with a score below the least; all columns as they were."""
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(held.value)
        for batch in batches:
            found = scorer.predict_all(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    if not isinstance(rows.schema[at].dataType, T.StringType):
        raise TypeError("text must be a string column")
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identified(docs, trained(docs))
