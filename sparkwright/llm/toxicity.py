"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks, trained on labelled sentences.

A unit is a word in lower case without punctuation; single letters in a row are one
unit, so that spelt-out and punctuated insults meet the plain form. A unit's features
are its subsequences of three characters within SPAN positions, each occurrence weighted by
DECAY per skipped position; the kernel of two units is the product of these features,
each divided by the length's norm. Gaps and inserted characters thus lower the kernel but do not
void it. Letters of all scripts are told apart: a-z, ß-ÿ and digits have classes of their own, other letters
one of 67 by a hash.

Fitting, on the driver, on at most SAMPLE toxic and SAMPLE other labelled training rows
of at most SAMPLE_CHARS characters (ids that hash lowest; a documented bound). A sentence has its text's label:

1. A squared-hinge SVM on sentences, by the sum of its units' kernels. It needs no landmarks, as only
   triples of units that occur in two rows or more take part.
2. What makes a toxic text toxic is in some of its sentences only. So, in ROUNDS rounds, each toxic text gives the unit of its
   sentences that the machine so far scores highest (its witness), those of other texts give units at random and all that come
   closest, and an SVM is fitted to these in the kernel's Nyström features; landmarks are witnesses and other units.
   Witnesses also take part with one character inserted. A witness that no other toxic text shares counts only if
   none is shared.

A text's score is that of its highest unit, which is that of its most toxic sentence, calibrated to 0..1. The kernel expansion over
landmarks is linear in the features, so it is folded into one weight per triple of characters, and whole texts are
scored by table look-ups.

Defined results: null and empty texts and texts without a unit of three characters have
the score of no evidence; a null doc_id is not held out and no training row; repeated rows have a result each, and count once
in fitting; several labels of one id count as the greatest; of witnesses that tie the one seen first counts; texts of any
length are read whole, in slices; columns of other names pass through ``civil_documents`` and are not read; an empty table gives no
rows, and without labelled rows of both kinds all score 0.
"""

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import chosen, documents, fold

SAMPLE, SAMPLE_CHARS = 2500, 20_000
SPAN, DECAY = 5, 0.6
MOST_LANDMARKS, OTHER_LANDMARKS, OTHER_UNITS, ROUNDS, RIDGE, SLACK, LIKELIER, BENT = 256, 64, 8000, 4, 1e-3, 0.1, 10, 3
SENTENCE_STEPS, SENTENCE_RATE, SENTENCE_L2 = 60, 0.1, 1e-4
FOLDS, HELD = 5, 0
SLICE_CHARS = 1 << 19
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")

#: Bits of a character's class. 0 separates, SKIP is left out, 1-26 a-z, 27-58 ß-ÿ, 59 digits, from 60 other letters.
BITS, SKIP, OTHERS = 7, 255, 60
TOP = 0x20000


def _classes() -> np.ndarray:
    out = np.full(TOP + 1, SKIP, np.uint8)
    out[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85]] = 0
    for code in range(0x80, TOP):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LNZ":
            out[code] = 0 if kind[0] == "Z" else 59 if kind[0] == "N" else _other(code)
    out[97:123], out[48:58] = np.arange(1, 27), 59
    accented = [c for c in range(0xDF, 0x100) if c != 0xF7]
    out[accented] = np.arange(27, 27 + len(accented))
    out[[0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE]] = SKIP
    out[TOP] = OTHERS  # rarer ideographs
    return out


def _other(code: int) -> int:
    return OTHERS + (code * 2654435761 >> 12) % ((1 << BITS) - OTHERS)


_made: list[np.ndarray] = []


def classes() -> np.ndarray:
    if not _made:
        _made.append(_classes())
    return _made[0]


OFFSETS = [(a, b) for b in range(2, SPAN + 1) for a in range(1, b)]


def norms(longest: int) -> np.ndarray:
    """The norm of a unit by its length, counting each occurrence of a subsequence as its own feature."""
    n = np.arange(longest + 1)
    return np.sqrt(sum(DECAY ** (2 * (b - 2)) * np.maximum(0, n - b) for _, b in OFFSETS))


def units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all characters of the units one after the other; where each unit begins; its text's number."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(lowered).encode("utf-32-le", "replace"), "<u4")
    ends = np.cumsum([len(t) + 1 for t in lowered])
    cls = classes()[np.minimum(code, TOP)]
    keep = cls != SKIP
    place = np.flatnonzero(keep)
    cls = cls[place]
    letter = cls != 0
    if not letter.any():
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    starts = np.flatnonzero(first)
    text = np.searchsorted(ends, place[starts], side="right")
    before = np.cumsum(letter) - letter
    begin = before[starts]
    chars = cls[letter]
    length = np.diff(np.append(begin, len(chars)))
    alone = length == 1
    new = np.ones(len(begin), bool)
    new[1:] = ~(alone[1:] & alone[:-1] & (text[1:] == text[:-1]))
    return chars, begin[new], text[new]


def triples(chars: np.ndarray, begin: np.ndarray):
    """For each pair of offsets: the places of first characters, the triples' codes, the weight."""
    unit = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(chars))))
    wide = chars.astype(np.int32)
    for a, b in OFFSETS:
        n = len(chars) - b
        if n > 0:
            yield n, unit[:n] == unit[b:], (wide[:n] << 2 * BITS) | (wide[a : n + a] << BITS) | wide[b:], DECAY ** (b - 2), unit


def unit_scores(chars, begin, table, norm) -> np.ndarray:
    """The kernel expansion's value of each unit; -inf for units of fewer than three characters."""
    gained = np.zeros(len(chars), np.float32)
    for n, same, code, weight, _ in triples(chars, begin):
        gained[:n] += table[code] * same * np.float32(weight)
    length = np.diff(np.append(begin, len(chars)))
    if len(norm) <= length.max():
        norm = norms(int(length.max()))
    scale = norm[length]
    return np.where(scale > 0, np.add.reduceat(gained, begin) / np.where(scale > 0, scale, 1), -np.inf)


def text_scores(texts: list[str], table, norm) -> np.ndarray:
    """The greatest unit score of each text, -inf without units."""
    out = np.full(len(texts), -np.inf)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
            size += len(texts[j])
            j += 1
        chars, begin, text = units(texts[i:j])
        if len(begin):
            np.maximum.at(out, i + text, unit_scores(chars, begin, table, norm))
        i = j
    return out


def _features(words: list[bytes], columns: np.ndarray) -> np.ndarray:
    """Normalised features of the words, restricted to the sorted codes in columns."""
    out = np.zeros((len(words), len(columns)), np.float32)
    chars = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    begin = np.cumsum(length) - length
    for n, same, code, weight, unit in triples(chars, begin):
        at = np.minimum(np.searchsorted(columns, code), len(columns) - 1)
        hit = same & (columns[at] == code)
        np.add.at(out, (unit[:n][hit], at[hit]), np.float32(weight))
    return out / norms(int(length.max()))[length][:, None]


def _codes(words: list[bytes]) -> np.ndarray:
    chars = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words])
    return np.unique(np.concatenate([code[same] for _, same, code, _, _ in triples(chars, np.cumsum(length) - length)]))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared hinge with a bias in the last place, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), SLACK)
    ridge[-1] = 1e-4
    for _ in range(30):
        own = y * (x @ w) < 1
        xa, ca = x[own], c[own]
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(ridge), (xa * ca[:, None]).T @ y[own])
        if np.allclose(new, w, atol=1e-6):
            break
        w = 0.5 * w + 0.5 * new if _ > 10 else new
    return w


def _sentence_machine(sentences: list[np.ndarray], text: np.ndarray, labels: np.ndarray, names: list[bytes], used: np.ndarray) -> np.ndarray:
    """The score of each unit in ``used`` by an SVM on sentences (arrays of units), whose features are the sums of their units'."""
    place = np.full(len(names), -1)
    place[used] = np.arange(len(used))
    word = place[np.concatenate(sentences)].astype(np.int32)
    sentence = np.repeat(np.arange(len(sentences), dtype=np.int32), [len(s) for s in sentences])[word >= 0]
    word = word[word >= 0]
    chars = np.frombuffer(b"".join(names[i] for i in used), np.uint8)
    length = np.array([len(names[i]) for i in used])
    scale = norms(int(length.max()))[length]
    begin = np.cumsum(length) - length
    number = np.zeros(1 << 3 * BITS, np.int32)  # triples that occur, numbered
    for _, same, code, _, _ in triples(chars, begin):
        number[code[same]] = 1
    count = int(number.sum())
    number = np.cumsum(number, dtype=np.int32) - 1
    # for each pair of offsets: units, triples and their weights
    parts = [(own := unit[:n][same], number[code[same]], (weight / scale[own]).astype(np.float32)) for n, same, code, weight, unit in triples(chars, begin)]

    def unit_values(w):
        return sum(np.bincount(own, value * w[triple], len(used)) for own, triple, value in parts)

    def triple_values(of):
        return sum(np.bincount(triple, value * of[own], count) for own, triple, value in parts)

    y = np.where(labels[text] > 0, 1.0, -1.0)
    share = 1 / np.bincount(text)[text]  # each text counts once, however many sentences it has, and both labels weigh the same
    for kind in (1.0, -1.0):
        share[y == kind] *= 0.5 / share[y == kind].sum()
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(sentence, minlength=len(sentences))))
    (w, first, second), bias = np.zeros((3, count)), np.zeros(3)
    for step in range(1, SENTENCE_STEPS + 1):
        margin = 1 - y * (np.bincount(sentence, unit_values(w)[word], len(sentences)) * scale + bias[0])
        pull = share * y * np.maximum(0, margin)  # of the squared hinge
        gradient = triple_values(np.bincount(word, (pull * scale)[sentence], len(used))) - SENTENCE_L2 * w
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        w += SENTENCE_RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        bias[1:] = 0.9 * bias[1] + 0.1 * pull.sum(), 0.99 * bias[2] + 0.01 * pull.sum() ** 2
        bias[0] += SENTENCE_RATE * bias[1] / (1 - 0.9**step) / (np.sqrt(bias[2] / (1 - 0.99**step)) + 1e-7)
    return unit_values(w)


def fit(rows) -> dict | None:
    """The model of (text, toxic) rows: a weight per triple and the calibration."""
    rng = np.random.default_rng(11)
    number: dict[bytes, int] = {}
    sentences, text, bags, labels, seen = [], [], [], [], set()
    for whole, toxic in rows:
        own = []
        parts = SENTENCE.split(whole or "")
        chars, begin, of = units(parts)
        raw, stops = chars.tobytes(), [*begin[1:].tolist(), len(chars)]
        ids = np.array([number.setdefault(raw[a:b], len(number)) if b - a >= 3 else -1 for a, b in zip(begin.tolist(), stops, strict=True)], np.int64)
        ids, of = ids[ids >= 0], of[ids >= 0]
        key = hashlib.blake2b(np.unique(ids).tobytes(), digest_size=16).digest(), toxic
        if len(ids) and key not in seen:  # copies count once
            seen.add(key)
            own = np.split(ids, np.flatnonzero(np.diff(of)) + 1)
            sentences += own
            text += [len(bags)] * len(own)
            bags.append(np.unique(ids))
            labels.append(int(toxic))
    names, labels, text = list(number), np.array(labels), np.array(text)
    if len(labels) == 0 or labels.min() or not labels.max():
        return None
    toxic = [b for b, t in zip(bags, labels, strict=True) if t]
    size = len(names)
    clean = [b for b, t in zip(bags, labels, strict=True) if not t]
    inside, outside = (np.bincount(np.concatenate(x), minlength=size) for x in (toxic, clean))
    every = inside + outside
    shared = np.flatnonzero(every >= (2 if (every > 1).any() else 1))
    value = np.full(size, -np.inf)
    value[shared] = _sentence_machine(sentences, text, labels, names, shared)
    pool = np.flatnonzero(outside)
    weight = outside[pool] ** 0.5
    others = [names[i] for i in pool[rng.choice(len(pool), min(OTHER_UNITS, len(pool)), replace=False, p=weight / weight.sum())]]
    hard: dict[bytes, None] = dict.fromkeys(others)
    norm, bound = norms(64), np.inf
    for _ in range(ROUNDS):
        # what a toxic text is thought toxic for: its highest unit, and all others beyond the machine's bound; likelier in toxic texts than elsewhere
        witness = np.concatenate([b[(value[b] > bound) | (value[b] == value[b].max())] for b in toxic])
        found, times = np.unique(witness, return_counts=True)
        likely = inside[found] * len(clean) > LIKELIER * outside[found] * len(toxic)
        for keep in (likely & (inside[found] > 1), likely, times > 0):
            if keep.any():
                break
        found, times = found[keep], times[keep]
        order = np.argsort(-times, kind="stable")
        found, times = found[order], times[order].astype(float)
        positive = [names[i] for i in found]
        landmarks = positive[:MOST_LANDMARKS] + others[:OTHER_LANDMARKS]
        columns = _codes(landmarks)
        base = _features(landmarks, columns)
        values, vectors = np.linalg.eigh((base @ base.T).astype(float))
        whiten = (vectors / np.sqrt(np.maximum(values, RIDGE))) @ vectors.T
        nystrom = lambda words: np.vstack([_features(words[k : k + 500], columns) @ base.T for k in range(0, len(words), 500)]) @ whiten  # noqa: B023, E731
        bent = []
        for w in positive * BENT:  # an inserted character leaves an insult an insult
            at = int(rng.integers(1, len(w)))
            bent.append(w[:at] + bytes([int(rng.integers(1, 27))]) + w[at:])
        negative = list(hard)
        features = np.vstack([nystrom(positive), nystrom(bent), nystrom(negative)])
        y = np.concatenate([np.ones(len(positive) + len(bent)), -np.ones(len(negative))])
        often = np.array([outside[number[u]] for u in negative], float)  # a unit of many other texts is the dearer mistake
        support = np.sqrt(np.append(times, np.tile(times, BENT)))
        w = _svm(features, y, np.append(support * (0.5 * often.sum() / support.sum()), often))
        del features
        table = np.zeros(1 << 3 * BITS, np.float32)
        table[columns] = (whiten @ w[:-1]) @ base
        for part in np.array_split(np.arange(size), max(1, size // 50_000)):
            length = np.array([len(names[i]) for i in part])
            value[part] = unit_scores(np.frombuffer(b"".join(names[i] for i in part), np.uint8), np.cumsum(length) - length, table, norm)
        bound = -w[-1]
        # the units of other texts that come closest are the next round's negatives
        hard.update(dict.fromkeys(names[i] for i in pool[value[pool] + w[-1] > -0.5]))
    score, y = np.array([value[b].max() for b in bags]), labels.astype(float)
    a, b = 1.0, float(w[-1])
    share = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(50):  # Platt's calibration with a little shrinkage, both kinds weighing the same
        p = 1 / (1 + np.exp(-np.clip(a * score + b, -30, 30)))
        g = np.array([(share * (p - y) * score).sum() + 1e-3 * a, (share * (p - y)).sum()])
        h = share * p * (1 - p)
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    at = np.flatnonzero(table)
    return {"codes": at.astype(np.int32), "weights": table[at], "a": float(a), "b": float(b)}


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> dict | None:
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter((fold(F.col("doc_id"), FOLDS) != HELD) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = chosen(marks.filter("toxic = 1"), "doc_id", sample).unionAll(chosen(marks.filter("toxic = 0"), "doc_id", sample))  # at most 2 * sample rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.length("text") <= sample_chars).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of repeated ids one text
    found = rows.select("doc_id", "text", "toxic").toArrow().sort_by("doc_id")
    return fit(zip(found["text"].to_pylist(), found["toxic"].to_pylist(), strict=True))


class Judge:
    def __init__(self, model: dict | None):
        self.model, self.norm = model, norms(64)
        self.table = np.zeros(1 << 3 * BITS, np.float32)
        if model:
            self.table[model["codes"]] = model["weights"]

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.model:
            return np.zeros(len(texts))
        value = text_scores(texts, self.table, self.norm)
        value = np.where(np.isfinite(value), value, -1.0)
        return 1 / (1 + np.exp(-np.clip(self.model["a"] * value + self.model["b"], -500, 500)))


def _strings(column) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(held.value)
        for batch in batches:
            score = judge.scores(_strings(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id").cast("long"), FOLDS) == HELD, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def civil_documents(docs: DataFrame, model: dict | None, most: float = 0.5) -> DataFrame:
    """docs that score below ``most``, all columns as they were."""
    names = docs.columns
    at = [n.lower() for n in names].index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        judge = Judge(held.value)
        for batch in batches:
            yield batch.filter(pa.array(judge.scores(_strings(batch.column(at))) < most))

    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    if not isinstance(rows.schema[at].dataType, T.StringType):
        raise TypeError("text must be a string column")
    return rows.mapInArrow(run, rows.schema).toDF(*names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, trained(docs, documents(spark, sf_dir, "labels")))
