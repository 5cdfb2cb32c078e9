"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

For a benchmark item of m words every window of m words of a document counts (the whole
document, if it is shorter). A window's shingles are its five-word runs, of an item of m < 5 words its
m-word run; a shingle's weight is how often it occurs. The fingerprint is the 256-bit SimHash of
the weighted shingles, in 16 blocks of 16 bits.

The index has every item under each value within REACH = 3 bits of each of its blocks. By the
pigeonhole principle two fingerprints within RADIUS = 63 bits are within 3 bits in one block at
least, so that looking up a window's 16 blocks misses no item within the radius. It proposes one item in
six at random (measured: 0.158 of 1,200,000 pairs of random fingerprints); those beyond MOST_BITS = 80 go, and the rest are
verified on the shingles, sum of least weights over sum of greatest, at NUM / DEN or more. At
similarity 0.75 fingerprints differ in 44 bits on average with deviation 6, so a miss has an estimated probability
below 1e-6 (measured recall in the tests: 1). A window that shares no shingle with any item has
similarity 0 to all, so fingerprints are made only of windows about a shared shingle; that loses nothing.

The benchmark is the stated query set. It is sent to the executors in blocks of about BLOCK_ITEMS
items and BLOCK_CHARS characters at most (one item at least), one scan of the documents for each, so what is broadcast is
bounded; a worker builds a block's index once.

Defined results: null or empty documents and items without words match nothing; an item of
fewer than five words matches wherever its words stand in a row; repeated rows of documents each
have their matches; items with the same text each match; of equal windows the first counts;
texts of any length are read whole; only doc_id (item_id) and text are read, and extra columns of any names pass
through ``clean_documents``; empty tables give no rows.
"""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import documents, texts

BLOCKS, BLOCK_BITS, REACH, MOST_BITS, NUM, DEN = 16, 16, 3, 80, 75, 100
RADIUS = BLOCKS * (REACH + 1) - 1
SHINGLE = 5
BLOCK_ITEMS, BLOCK_CHARS = 1000, 16 << 20
#: Windows fingerprinted, and pairs that the index proposes, at once.
STRETCH, PROPOSALS = 8192, 1 << 21
SCHEMA = "doc_id long, item_id long, similarity double, first_word long, window_words long"

U64 = np.uint64
_seeds = W.mix(np.arange(7000, 7004, dtype=U64))
#: All differences of a block's value within REACH bits.
NEAR = np.array([sum(1 << b for b in bits) for n in range(REACH + 1) for bits in combinations(range(BLOCK_BITS), n)], np.uint32)


def signs(shingles: np.ndarray, block: int) -> np.ndarray:
    """+1 or -1 for each shingle and each bit of a block."""
    own = W.mix(shingles ^ _seeds[block // 4]) >> U64(BLOCK_BITS * (block % 4))
    return (((own[:, None] >> np.arange(BLOCK_BITS, dtype=U64)) & U64(1)).astype(np.int8) << 1) - 1


def fingerprints(shingles: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """The 16 block values (uint32) of each window of ``span`` shingles."""
    out = np.empty((len(starts), BLOCKS), np.uint32)
    base = int(starts[0])
    part, at = shingles[base : int(starts[-1]) + span], starts - base
    for block in range(BLOCKS):
        running = np.zeros((len(part) + 1, BLOCK_BITS), np.int32)
        np.cumsum(signs(part, block), axis=0, dtype=np.int32, out=running[1:])
        out[:, block] = ((running[at + span] > running[at]).astype(np.uint32) << np.arange(BLOCK_BITS, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    return out


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class Index:
    """Items by number of words, with the tables of their fingerprints' blocks."""

    def __init__(self, items: list[tuple[int, str | None]]):
        data, offsets = W.buffers(pa.array([t for _, t in items], pa.string()))
        hashes, first = W.words(data, offsets)
        self.ids, sizes, self.items, prints = [], [], [], []
        for (item_id, _), a, b in zip(items, first[:-1], first[1:], strict=True):
            if b > a:
                own = W.runs(hashes[a:b], min(int(b - a), SHINGLE))
                self.ids.append(item_id)
                sizes.append(int(b - a))
                self.items.append(own)
                prints.append(fingerprints(own, np.zeros(1, np.int64), len(own))[0])
        self.prints = np.array(prints, np.uint32).reshape(-1, BLOCKS)
        self.sizes, kind = np.unique(np.array(sizes, np.int64), return_inverse=True)
        self.counts: list[dict | None] = [None] * len(self.items)
        # each shingle with the sizes of the items that have it
        pairs = np.concatenate([*(np.stack([x, np.full(len(x), k, U64)]) for x, k in zip(self.items, kind, strict=True)), np.zeros((2, 0), U64)], axis=1)
        order = np.lexsort(pairs[::-1])
        pairs = pairs[:, order]
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(axis=0)
        self.known, self.kind = pairs[0, new], pairs[1, new].astype(np.int64)
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.known >> U64(42)).astype(np.int64)] = True
        # the multi-index: size, block and value in one key
        self.of_kind = [np.flatnonzero(kind == k) for k in range(len(self.sizes))]
        lead = (kind.astype(np.uint32)[:, None] << np.uint32(20)) | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16))
        keys = (lead[:, :, None] | (self.prints[:, :, None] ^ NEAR)).reshape(-1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], (order // (BLOCKS * len(NEAR))).astype(np.int32)

    def units(self) -> list[int]:
        return sorted({min(int(s), SHINGLE) for s in self.sizes})

    def anchors(self, shingles: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has."""
        maybe = np.flatnonzero(self.seen[(shingles >> U64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.known):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == shingles[maybe]]

    def proposals(self, kind: int, prints: np.ndarray):
        """Pairs (window, item of that size) that agree within REACH bits in one block at least."""
        queries = ((np.uint32(kind << 20) | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(16))) | prints).reshape(-1)
        low, high = np.searchsorted(self.keys, queries, "left"), np.searchsorted(self.keys, queries, "right")
        total = np.cumsum((high - low).reshape(-1, BLOCKS).sum(axis=1))
        edges = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]) + 1, PROPOSALS)), len(prints)))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            a, n = low[i * BLOCKS : j * BLOCKS], (high - low)[i * BLOCKS : j * BLOCKS]
            place = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            window = np.repeat(np.arange(i * BLOCKS, j * BLOCKS) // BLOCKS, n)
            code = np.unique(window * len(self.items) + self.owner[place])
            yield code // len(self.items), code % len(self.items)

    def best(self, shingles: np.ndarray, item: int, starts: list[int], span: int) -> tuple[float, int]:
        """The greatest similarity of an item to windows that begin at ``starts`` (ascending), and the first such place; 0 below the least. One shingle in, one out."""
        if self.counts[item] is None:
            self.counts[item] = Counter(self.items[item].tolist())
        own, size = self.counts[item], len(self.items[item])
        best, place, at, held, shared = 0.0, 0, None, {}, 0
        for start in starts:
            if at is None or start - at >= span:
                held, shared, at = Counter(shingles[start : start + span].tolist()), 0, start
                shared = sum(min(n, own.get(x, 0)) for x, n in held.items())
            for gone, came in zip(shingles[at:start].tolist(), shingles[at + span : start + span].tolist(), strict=True):
                held[gone] -= 1
                shared -= held[gone] < own.get(gone, 0)
                held[came] = held.get(came, 0) + 1
                shared += held[came] <= own.get(came, 0)
            at = start
            union = span + size - shared
            if shared * DEN >= union * NUM and shared / union > best:
                best, place = shared / union, start
        return best, place

    def matches(self, kind: int, shingles: np.ndarray, anchors: np.ndarray, n_words: int):
        """(item_id, similarity, first word, words) of each item of one size that windows of a document match."""
        size = int(self.sizes[kind])
        span = min(size - min(size, SHINGLE) + 1, len(shingles))
        last = len(shingles) - span
        cover = np.zeros(last + 2, np.int32)
        np.add.at(cover, np.minimum(np.maximum(anchors - span + 1, 0), last), 1)
        np.add.at(cover, np.minimum(anchors, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        found: dict[int, list[int]] = {}
        for part in np.split(starts, np.flatnonzero(np.diff(starts // STRETCH)) + 1):
            prints = fingerprints(shingles, part, span)
            for window, item in self.proposals(kind, prints):
                near = apart(prints[window], self.prints[item]) <= MOST_BITS
                for w, k in zip(part[window[near]].tolist(), item[near].tolist(), strict=True):
                    found.setdefault(k, []).append(w)
        for k, places in found.items():
            similarity, start = self.best(shingles, k, places, span)
            if similarity:
                yield self.ids[k], similarity, start, min(size, n_words)


class Items:
    """A block of the benchmark; its index is made where it is used, once in a process."""

    def __init__(self, items):
        self.items, self.made = items, None

    def __getstate__(self):
        return {"items": self.items, "made": None}

    def index(self) -> Index:
        if self.made is None:
            self.made = Index(self.items)
        return self.made


def scan(column, index: Index):
    """(row, {item_id: (similarity, first word, words)}) of each text of an Arrow column that matches an item."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        hashes, first = W.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        best: dict[int, dict[int, tuple]] = {}
        for unit in index.units():
            runs = W.runs(hashes, unit)
            hit = index.anchors(runs)
            rows = np.searchsorted(first, hit, side="right") - 1
            inside = hit + unit <= first[rows + 1]
            hit, rows = hit[inside], rows[inside]
            # every anchor with each size of the items that have its shingle
            low, n = (x := np.searchsorted(index.known, runs[hit], "left")), np.searchsorted(index.known, runs[hit], "right") - x
            kind = index.kind[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            row, place = np.repeat(rows, n), np.repeat(hit, n)
            order = np.lexsort((place, kind, row))
            row, kind, place = row[order], kind[order], place[order]
            edges = [*np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(kind) != 0))).tolist(), len(row)] if len(row) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                r, k = int(row[a]), int(kind[a])
                if min(int(index.sizes[k]), SHINGLE) != unit:
                    continue
                words = int(first[r + 1] - first[r])
                own = runs[first[r] : first[r + 1] - unit + 1]
                for item_id, similarity, start, size in index.matches(k, own, place[a:b] - first[r], words):
                    known = best.setdefault(r, {})
                    if item_id not in known or (-similarity, start) < (-known[item_id][0], known[item_id][1]):
                        known[item_id] = similarity, start, size
        for r in sorted(best):
            yield i + r, best[r]


def blocks(benchmark: DataFrame):
    """The items in bounded blocks, by ranges of a hash; one block for a usual benchmark."""
    items = texts(benchmark, "item_id").withColumnRenamed("doc_id", "item_id").filter("text is not null")
    chars, count = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    n = max(1, -(-int(chars) // BLOCK_CHARS), -(-count // BLOCK_ITEMS))
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Items(sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that match: the best window's similarity, first word and length."""
    sc, out = docs.sparkSession.sparkContext, None
    for items in blocks(benchmark):
        held = sc.broadcast(items)

        def run(batches, held=held):
            index = held.value.index()
            for batch in batches:
                ids = batch.column("doc_id")
                rows = [(ids[row].as_py(), item, *m) for row, best in scan(batch.column("text"), index) for item, m in sorted(best.items(), key=lambda x: (x[0] is None, x[0] or 0))]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "item_id", "similarity", "first_word", "window_words"])

        found = texts(docs).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that match an item, all columns as they were. No join: each block's scan passes the others on."""
    at = [n.lower() for n in docs.columns].index("text")
    kept = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    if not isinstance(kept.schema[at].dataType, T.StringType):
        raise TypeError("text must be a string column")
    for items in blocks(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches, held=held):
            index = held.value.index()
            for batch in batches:
                stay = np.ones(batch.num_rows, bool)
                stay[[row for row, _ in scan(batch.column(at), index)]] = False
                yield batch.filter(pa.array(stay))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.toDF(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
