"""Language-model scoring by a weighted backoff automaton over smoothed word trigrams.

Tokens are words (lower-cased A-Z), then one end. Unigrams are smoothed as in the base score,
P(w) = (c + 0.5) / (N + 0.5 (V + 1)), over all training tokens. Bigrams and trigrams are
smoothed by absolute discounting, interpolated with the next lower order, so that each
state's probabilities sum to one. No n-gram is left out. Contexts are states; a state's
arcs carry log10 probabilities to the next state, its failure arc the backoff weight to
the shorter context. A text is one left-to-right traversal from the start state.

The automaton is never in one place. Its counts lie in ranges of hashes: a pair and all triples
that begin with it in one, a word in one. Texts are packed into blocks; a block asks each range
once for its distinct n-grams, with its own training counts of them, and the task that holds a
range adds the blocks' counts and answers each block. A block that has its answers knows every
arc on its texts' ways. Ranges and blocks grow in number, not in size; a frequent n-gram
comes once from each block. Nothing that grows is broadcast or collected. ``Automaton`` is the same automaton
in one piece, for small counts.

Defined results: null and empty texts are one end; a null doc_id is not held out and no
training row; repeated rows each have a result, and each counts in training; texts of any length are read whole, a longer one than a block
being a block of its own; ties cannot occur; only doc_id and text are read, whatever other columns there are; without training rows N and V are 0
and all tokens are equally unlikely; an empty table gives no rows.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import cut, documents, fold

DISCOUNT = 0.75
#: Tokens of a block and of a range; at least so many ranges, counted in so many waves, so that only one wave's shuffle lies on disk.
BLOCK, ENTRIES, RANGES, WAVES = 1_000_000, 4_000_000, 64, 2
FOLDS, HELD = 5, 1

U64 = np.uint64
_two = W.mix(np.arange(50, 52, dtype=U64)) | U64(1)
#: Ids of the start and the end in the automaton; words have ids from 2.
START, END = 0, 1
START_HASH, END_HASH = W.mix(np.array([1, 2], U64))


def framed(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word hashes with a start before and an end after each; where each text begins (n + 1 entries)."""
    n = len(first) - 1
    at = first + 2 * np.arange(n + 1)
    out = np.empty(int(at[-1]), U64)
    rest = np.ones(len(out), bool)
    out[at[:-1]], out[at[1:] - 1] = START_HASH, END_HASH
    rest[at[:-1]] = rest[at[1:] - 1] = False
    out[rest] = hashes
    return out, at


def _slices(batch):
    """(row range, framed hashes, starts) of an Arrow batch's texts."""
    data, offsets = W.buffers(batch.column("text"))
    for i, j in W.slices(offsets):
        yield i, j, *framed(*W.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def _rows(docs: DataFrame) -> DataFrame:
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    number = fold(F.col("doc_id"), FOLDS)
    return rows.select("doc_id", F.xxhash64("text").alias("uid"), F.coalesce(number == HELD, F.lit(False)).alias("held_out"), F.coalesce(number != HELD, F.lit(False)).alias("train"), "text")


class Automaton:
    """States from n-gram counts by ids. ``ones``: counts by id, START's being the number of training texts."""

    def __init__(self, ones: np.ndarray, double: dict[int, int], triple: dict[int, int], n: int, v: int):
        size = len(ones)
        floor = math.log10(n + 0.5 * (v + 1)) if n or v else math.log10(0.5)
        base = (ones + 0.5) / 10**floor
        self.floor, self.logs = floor, np.log10(ones + 0.5)
        by_one: dict[int, list[tuple[int, int]]] = {}
        by_two: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for key, c in double.items():
            by_one.setdefault(key // size, []).append((key % size, c))
        for key, c in triple.items():
            pair, w = divmod(key, size)
            if pair in double:
                by_two.setdefault(divmod(pair, size), []).append((w, c))
        single = {h: k for k, h in enumerate(sorted(by_one), 1)}
        pairs = {p: k for k, p in enumerate(sorted(by_two), len(single) + 1)}
        start = single.get(START, 0)
        after = lambda w: start if w == END else single.get(w, 0)
        count = len(single) + len(pairs) + 1
        self.fail, self.cost, self.arcs = [0] * count, [0.0] * count, [{} for _ in range(count)]
        log = np.log10(base).tolist()
        self.arcs[0] = {w: (after(w), log[w]) for w in range(1, size)}
        chance: dict[int, dict[int, float]] = {}
        back: dict[int, float] = {}
        for h, s in single.items():
            total = int(ones[h])
            kept = {w: max(c - DISCOUNT, 0) / total for w, c in by_one[h]}
            back[h] = max(1 - sum(kept.values()), 1e-12)
            chance[h] = {w: p + back[h] * base[w] for w, p in kept.items()}
            self.cost[s] = math.log10(back[h])
            self.arcs[s] = {w: (pairs.get((h, w)) or after(w), math.log10(p)) for w, p in chance[h].items()}
        for (g, h), s in pairs.items():
            total = double[g * size + h]
            kept = {w: max(c - DISCOUNT, 0) / total for w, c in by_two[g, h]}
            rest = max(1 - sum(kept.values()), 1e-12)
            lower, lower_back = chance.get(h, {}), back.get(h, 1.0)
            self.fail[s], self.cost[s] = single.get(h, 0), math.log10(rest)
            self.arcs[s] = {w: (pairs.get((h, w)) or after(w), math.log10(p + rest * lower.get(w, lower_back * base[w]))) for w, p in kept.items()}
        self.start = start
        self.down = [0.0] * count  # weights of all failure arcs down to no context
        for s in range(1, count):
            self.down[s] = self.cost[s] + (self.down[self.fail[s]] if self.fail[s] else 0.0)

    def traverse(self, ids: list[int]) -> float:
        """log10 probability of the ids after a start; of a rare word (-1) only the way down, its unigram being added elsewhere."""
        state, total, arcs, fail, cost, down = self.start, 0.0, self.arcs, self.fail, self.cost, self.down
        for w in ids:
            if w < 0:
                total += down[state]
                state = 0
                continue
            arc = arcs[state].get(w)
            while arc is None:
                total += cost[state]
                state = fail[state]
                arc = arcs[state].get(w)
            state, gain = arc
            total += gain
        return total


def _blocks(batches):
    """Ids, null ids, held out, train, framed hashes and starts of about BLOCK tokens of texts each."""
    parts, tokens = [], 0

    def joined():
        *columns, h, at = zip(*parts, strict=True)
        begin = np.cumsum([0, *map(len, h)])
        return *map(np.concatenate, columns), np.concatenate(h), np.append(np.concatenate([a[:-1] + b for a, b in zip(at, begin[:-1], strict=True)]), begin[-1])

    for batch in batches:
        columns = np.asarray(batch.column("doc_id").fill_null(0)), np.asarray(batch.column("doc_id").is_null()), np.asarray(batch.column("held_out")), np.asarray(batch.column("train"))
        for i, j, h, at in _slices(batch):
            parts.append((*(c[i:j] for c in columns), h, at))
            tokens += len(h)
            if tokens >= BLOCK:
                yield joined()
                parts, tokens = [], 0
    if parts:
        yield joined()


def _name(h: np.ndarray) -> int:
    """A block's name from its content, so that each scan gives it the same."""
    return int(W.mix(W.mix(h + np.arange(len(h), dtype=U64) * _two[1]).sum(dtype=U64, keepdims=True)).view(np.int64)[0])


def _range(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (hashes >> U64(32)).astype(np.int64) * ranges >> 32


def _squeeze(a: np.ndarray) -> bytes:
    raw = a.astype("<u4").tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _spread(b: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd"), "<u4").astype(np.int64)


class Grams:
    """A block's distinct words, pairs and triples, and which of them stands at each place; -1 where none ends. Triples only of pairs in the ranges ``own``."""

    def __init__(self, h: np.ndarray, at: np.ndarray, ranges: int, own: range | None = None):
        self.words, self.word = np.unique(h, return_inverse=True)
        size = len(self.words)
        ends = np.ones(len(h), bool)  # a pair ends wherever no text starts, a triple where also a pair ended before
        ends[at[:-1]] = False
        self.pair, self.triple = np.full(len(h), -1), np.full(len(h), -1)
        k = np.flatnonzero(ends)
        pairs, self.pair[k] = np.unique(self.word[k - 1] * size + self.word[k], return_inverse=True)
        self.first = self.words[pairs // size]
        self.pairs = W.mix(self.first * _two[0] + self.words[pairs % size] * _two[1])
        self.of, self.own = _range(self.pairs, ranges), own or range(ranges)
        k = k[ends[k - 1]]
        if own:
            k = k[((self.of >= own.start) & (self.of < own.stop))[self.pair[k - 1]]]
        triples, self.triple[k] = np.unique(self.pair[k - 1] * size + self.word[k], return_inverse=True)
        self.context, self.third = triples // size, self.words[triples % size]

    def places(self):
        """For each own range that has some: its pairs, and the triples that begin with them, by pair."""
        of, of3, low, high = self.of, self.of[self.context], self.own.start, self.own.stop
        pairs = np.flatnonzero((of >= low) & (of < high))
        pairs, triples = pairs[np.argsort(of[pairs], kind="stable")], np.argsort(of3, kind="stable")
        cut2, cut3 = (np.searchsorted(x, np.arange(low, high + 1)) for x in (of[pairs], of3[triples]))
        for k in np.flatnonzero(np.diff(cut2)).tolist():
            yield low + k, pairs[cut2[k] : cut2[k + 1]], triples[cut3[k] : cut3[k + 1]]


def _word_places(words: np.ndarray, ranges: int):
    of = _range(words, ranges)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(ranges + 1))
    for r in np.flatnonzero(np.diff(edges)).tolist():
        yield r, order[edges[r] : edges[r + 1]]


#: A row goes to the range or block ``to``; what it holds goes back to, or is from, ``at``.
MESSAGE = "kind int, to long, at long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
_fields = [c.split()[0] for c in MESSAGE.split(", ")]
_kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
PAIRS, WORDS, PART, PAIRS_BACK, WORDS_BACK, TEXTS, SEEN = range(7)


def _message(*row) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*row, *[None] * (10 - len(row))], _kinds, strict=True)], _fields)


def _groups(batches):
    """Rows in lists of equal ``to``; they come sorted by it."""
    own: list[dict] = []
    for batch in batches:
        for k in range(batch.num_rows):
            row = {c: batch.column(c)[k].as_py() for c in _fields}
            if own and own[-1]["to"] != row["to"]:
                yield own
                own = []
            own.append(row)
    if own:
        yield own


def _dealt(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "to").sortWithinPartitions("to")


def _joined(own: list[dict], column: str, read) -> tuple[np.ndarray, np.ndarray]:
    """The rows' arrays in one, and where each begins."""
    parts = [read(r[column]) for r in own]
    return np.concatenate(parts), np.cumsum([0, *map(len, parts)])


_hashes = lambda b: np.frombuffer(b, U64)


def _short(hashes: np.ndarray, size: int) -> bytes:
    """So many bytes of each hash: 7 tell the pairs of a range apart, 6 the words after one pair."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _long(b: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(b) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(b, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def pairs_counted(rows: DataFrame, ranges: int, own: range, least: float) -> DataFrame:
    """Of the pairs in the ranges ``own``, and of the triples that begin with them, the training counts back to each block that has them; of their first words, the pairs and their counts to the words' ranges."""

    def pack(batches):
        for _, _, _, train, h, at in _blocks(batches):
            g, name, learn = Grams(h, at, ranges, own), _name(h), np.repeat(train, np.diff(at))
            n2 = np.bincount(g.pair[learn & (g.pair >= 0)], minlength=len(g.pairs))
            n3 = np.bincount(g.triple[learn & (g.triple >= 0)], minlength=len(g.third))
            after = np.bincount(g.context, minlength=len(g.pairs))
            for r, p, t in g.places():
                runs = np.flatnonzero(np.append(True, np.diff(g.first[p]) != 0))  # pairs stand by first word
                yield _message(PAIRS, r, name, g.first[p][runs].tobytes(), _short(g.pairs[p], 7), _squeeze(n2[p]), _squeeze(after[p]), _short(g.third[t], 6), _squeeze(n3[t]), _squeeze(np.diff(np.append(runs, len(p)))))

    def total(batches):
        for rows in _groups(batches):
            first = np.repeat(_joined(rows, "a", _hashes)[0], _joined(rows, "g", _spread)[0])
            pair, edge2 = _joined(rows, "b", lambda b: _long(b, 7))
            n2, n3, after = (_joined(rows, c, _spread)[0] for c in "cfd")
            third, edge3 = _joined(rows, "e", lambda b: _long(b, 6))
            _, begin, place2 = np.unique(pair, return_index=True, return_inverse=True)
            n2 = np.bincount(place2, n2, len(begin)).astype(np.int64)
            place3 = np.repeat(place2, after)
            order = np.lexsort((third, place3))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(place3[order]) != 0) | (np.diff(third[order]) != 0)
            where = np.empty(len(order), np.int64)
            where[order] = np.cumsum(new) - 1
            n3 = np.bincount(where, n3, int(new.sum())).astype(np.int64)
            n3[n3 < least] = 0
            context = place3[order][new]
            kept, types = np.bincount(context, n3, len(begin)).astype(np.int64), np.bincount(context[n3 > 0], minlength=len(begin))
            for k, r in enumerate(rows):
                p, t = place2[edge2[k] : edge2[k + 1]], where[edge3[k] : edge3[k + 1]]
                yield _message(PAIRS_BACK, r["at"], r["to"], _squeeze(n2[p]), _squeeze((n2 - kept)[p]), _squeeze(types[p]), _squeeze(n3[t]))
            had = (n2 > 0) & (n2 >= least)
            word, place = np.unique(first[begin][had], return_inverse=True)
            of, n = _range(word, ranges), np.bincount(place, n2[had], len(word)).astype(np.int64)
            types = np.bincount(place, minlength=len(word))
            for q in np.unique(of).tolist():
                w = of == q
                yield _message(PART, q, 0, word[w].tobytes(), _squeeze(n[w]), _squeeze(types[w]))

    return _dealt(rows.mapInArrow(pack, MESSAGE), len(own)).mapInArrow(total, MESSAGE)


def words_counted(rows: DataFrame, parts: DataFrame, ranges: int) -> DataFrame:
    """Of the words of each block the training counts, and the pairs that begin with them and their counts, back to the block; how many words training has (SEEN)."""

    def pack(batches):
        for _, _, _, train, h, at in _blocks(batches):
            name, (words, word) = _name(h), np.unique(h, return_inverse=True)
            n = np.bincount(word[np.repeat(train, np.diff(at))], minlength=len(words))
            for r, w in _word_places(words, ranges):
                yield _message(WORDS, r, name, words[w].tobytes(), _squeeze(n[w]))

    def total(batches):
        for rows in _groups(batches):
            asked, pairs = ([r for r in rows if r["kind"] == k] for k in (WORDS, PART))
            if not asked:
                continue
            word, edge = _joined(asked, "a", _hashes)
            known, place = np.unique(word, return_inverse=True)
            n = np.bincount(place, _joined(asked, "b", _spread)[0], len(known)).astype(np.int64)
            kept, types = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
            for r in pairs:
                at = np.searchsorted(known, _hashes(r["a"]))
                kept[at] += _spread(r["b"])
                types[at] += _spread(r["c"])
            yield _message(SEEN, 0, int(((n > 0) & (known != START_HASH)).sum()))
            for k, r in enumerate(asked):
                p = place[edge[k] : edge[k + 1]]
                yield _message(WORDS_BACK, r["at"], r["to"], _squeeze(n[p]), _squeeze((n - kept)[p]), _squeeze(types[p]))

    return _dealt(rows.mapInArrow(pack, MESSAGE).unionAll(parts), ranges).mapInArrow(total, MESSAGE)


def _backoff(n: np.ndarray, lost: np.ndarray, types: np.ndarray) -> np.ndarray:
    """Weights of the failure arcs of contexts seen n times, ``lost`` of them before n-grams that are left out."""
    return np.where(n > 0, np.maximum((lost + DISCOUNT * types) / np.maximum(n, 1), 1e-12), 1.0)


def traversed(rows: DataFrame, back: DataFrame, ranges: int, blocks: int, least: float, n: int, v: int) -> DataFrame:
    """Each text's way through the automaton, with the arcs' counts that its block got back."""
    floor = math.log10(n + 0.5 * (v + 1)) if n or v else math.log10(0.5)

    def pack(batches):
        for ids, null, held_out, _, h, at in _blocks(batches):
            words, word = np.unique(h, return_inverse=True)
            yield _message(TEXTS, _name(h), 0, ids.astype("<i8").tobytes(), (null | held_out.astype(np.uint8) << 1).astype(np.uint8).tobytes(), at.astype("<i8").tobytes(), words.tobytes(), word.astype("<u4").view(np.uint8).reshape(-1, 4)[:, : 3 if len(words) < 1 << 24 else 4].tobytes())

    def run(batches):
        for rows in _groups(batches):
            answers = {(r["kind"], r["at"]): r for r in rows if r["kind"] != TEXTS}
            for r in (r for r in rows if r["kind"] == TEXTS):
                ids, flags, at, words = (np.frombuffer(r[c], t) for c, t in zip("abcd", ("<i8", np.uint8, "<i8", U64), strict=True))
                width = 3 if len(words) < 1 << 24 else 4
                word = np.zeros((len(r["e"]) // width, 4), np.uint8)
                word[:, :width] = np.frombuffer(r["e"], np.uint8).reshape(-1, width)
                g = Grams(words[word.reshape(-1).view("<u4")], at, ranges)
                one, lost1, types1 = np.zeros((3, len(g.words)), np.int64)
                two, lost2, types2 = np.zeros((3, len(g.pairs)), np.int64)
                three = np.zeros(len(g.third), np.int64)
                for k, w in _word_places(g.words, ranges):
                    a = answers[WORDS_BACK, k]
                    one[w], lost1[w], types1[w] = (_spread(a[c]) for c in "abc")
                for k, p, t in g.places():
                    a = answers[PAIRS_BACK, k]
                    two[p], lost2[p], types2[p], three[t] = (_spread(a[c]) for c in "abcd")
                k = np.flatnonzero(g.pair >= 0)
                n1, n2 = one[g.word[k - 1]], two[g.pair[k]]
                logs = np.log10(one[g.word[k]] + 0.5)
                chance = np.where((n2 > 0) & (n2 >= least), (n2 - DISCOUNT) / np.maximum(n1, 1), 0) + _backoff(one, lost1, types1)[g.word[k - 1]] * 10 ** (logs - floor)
                deep = g.triple[k] >= 0
                context, n3 = g.pair[k[deep] - 1], three[g.triple[k[deep]]]
                chance[deep] = np.where(n3 > 0, (n3 - DISCOUNT) / np.maximum(two[context], 1), 0) + _backoff(two, lost2, types2)[context] * chance[deep]
                tokens = np.diff(at) - 1
                begin = np.cumsum(tokens) - tokens
                known = np.add.reduceat(one[g.word[k]] > 0, begin, dtype=np.int64)
                base, score = np.add.reduceat(logs, begin) - tokens * floor, np.add.reduceat(np.log10(chance), begin)
                columns = [pa.array(ids, mask=flags & 1 > 0), pa.array(flags & 2 > 0), *map(pa.array, (tokens, known, np.full(len(ids), n), base, score))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _dealt(rows.mapInArrow(pack, MESSAGE).unionAll(back), blocks).mapInArrow(run, SCORED)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def tokens(rows: DataFrame) -> tuple[int, int]:
    """Of all texts with their starts, and of the training texts without."""

    def run(batches):
        for batch in batches:
            train, (data, offsets) = np.asarray(batch.column("train")), W.buffers(batch.column("text"))
            for i, j in W.slices(offsets):
                n = W.counted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) + 1
                yield pa.RecordBatch.from_arrays([pa.array([int((n + 1).sum())]), pa.array([int(n[train[i:j]].sum())])], ["every", "n"])

    found = rows.mapInArrow(run, "every long, n long").agg(F.sum("every"), F.sum("n")).first()
    return found[0] or 0, found[1] or 0


def scored(docs: DataFrame, share: float = 0.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Pairs and triples under ``share`` of the training tokens are left out."""
    spark, rows = docs.sparkSession, _rows(docs)
    every, n = tokens(rows)
    ranges, blocks = max(RANGES, -(-every // ENTRIES)), max(spark.sparkContext.defaultParallelism, -(-every // BLOCK))
    waves = []
    for k in range(WAVES):
        waves.append(cut(pairs_counted(rows, ranges, range(k * ranges // WAVES, (k + 1) * ranges // WAVES), share * n)))
    pairs = reduce(DataFrame.unionAll, waves)
    words = cut(words_counted(rows, pairs.filter(F.col("kind") == PART), ranges))
    v = words.filter(F.col("kind") == SEEN).agg(F.sum("at")).first()[0] or 0
    back = pairs.filter(F.col("kind") == PAIRS_BACK).unionAll(words.filter(F.col("kind") == WORDS_BACK))
    return traversed(rows, back, ranges, blocks, share * n, n, int(v))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
