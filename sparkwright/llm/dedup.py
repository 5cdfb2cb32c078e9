"""MinHash near-dedup: fast similarity sketches, banding, exact verification, components.

The sketch follows Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching": in each
round every element goes to one hashed bin, a bin keeps the least value of the first
round that reaches it, and after t random rounds t more send all elements to one bin
each. So every coordinate fills, after about one round for sets larger than t, and the
share of equal coordinates concentrates about the similarity as with t independent
MinHashes.

Flow, all of it distributed:

1. One scan makes per document the number of distinct shingles, a 128-bit digest of the
   set, the band keys, and one bit per coordinate. Documents of one set are one class.
2. Each class sends its band keys. A bucket of several classes links all to its least
   (a star, linear in the bucket). Stars are verified on the full sets.
3. Components of the verified links. Buckets that then hold several components may hide
   links across them. Of up to SMALL members the pairs across components are verified like
   the stars; for larger ones see ``links_across``. What is left unverified lies within
   one component or shares no band.

With r = 4 rows in b = 32 bands two sets of similarity 0.75 share no band with
probability (1 - 0.75**4)**32 < 6e-6, of 0.8 < 5e-8. Of 128 sketch bits such a pair differs
in 16 on average, deviation 3.8; pairs of more than MOST_BITS = 44 are not verified.

Hot groups: all buckets are tables before they are joined, so that a join's sides are plain shuffles, which
adaptive execution splits where one band is large; the links of a document that is the least of many, and the pairs of a
large bucket, are dealt by chunks of CHUNK members.

Defined results: null or empty text, or one of white space only, has 0 shingles and is linked with nothing; a null
doc_id takes no part in linking, is kept and has a null component_id; repeated rows
each have a result; rows with one doc_id count as one document in components; texts of any length are read whole,
in slices of bounded size; of equal documents the least doc_id stands for all; only doc_id and text are read, and
extra columns of any names pass through ``kept_documents``; an empty table gives no rows.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .shared import cut, documents, texts

COORDINATES, ROWS, BANDS = 128, 4, 32
MOST_BITS = 44
#: Links that a task of the components' rounds gets.
TASK_LINKS = 50_000
#: Members of a bucket up to which its pairs are listed; larger buckets go another exact way.
SMALL = 8
#: Similarity at least NUM / DEN.
NUM, DEN = 75, 100
#: Members of a star or of a large bucket that meet in one group of its links.
CHUNK = 512
#: Bits of the filter that finds linked candidates in the second scan, at most (8 MB): with 16 a document, as many documents as it can tell.
MOST_FILTER_BITS = 1 << 26
#: Rows of keys up to which they are broadcast (about 64 MB); more are joined by shuffle.
MOST_BROADCAST = 1_000_000

U64 = np.uint64
_seed = W.mix(np.arange(1, 2 * COORDINATES + 1, dtype=U64) * U64(0xD1342543DE82EF95))
_shift = U64(64 - (COORDINATES.bit_length() - 1))
_low = U64((1 << 56) - 1)
_fold = W.mix(np.arange(1000, 1000 + ROWS, dtype=U64)) | U64(1)
_band = W.mix(np.arange(2000, 2000 + BANDS, dtype=U64))


def sketch(items: np.ndarray) -> np.ndarray:
    """COORDINATES values of a non-empty set of 64-bit hashes. The top byte is the round, so that earlier rounds win."""
    out = np.full(COORDINATES, ~U64(0), U64)
    n, i = len(items), 0
    while i < COORDINATES:
        many = min(COORDINATES - i, max(1, 2048 // n))
        h = W.mix(items[None, :] ^ _seed[i : i + many, None])
        value = (h & _low) | (np.arange(i, i + many, dtype=U64) << U64(56))[:, None]
        np.minimum.at(out, (h >> _shift).astype(np.int64).ravel(), value.ravel())
        i += many
        if (out != ~U64(0)).all():
            return out
    for b in np.flatnonzero(out == ~U64(0)):  # the rounds of one bin each
        i = COORDINATES + int(b)
        out[b] = (W.mix(items ^ _seed[i]) & _low).min() | (U64(i) << U64(56))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    return W.mix((coordinates.reshape(BANDS, ROWS) * _fold).sum(axis=1, dtype=U64) ^ _band)


def sets(column):
    """The sorted distinct shingles of each text of an Arrow column, one after the other."""
    data, offsets = W.buffers(column)
    for i, j in W.slices(offsets):
        hashes, first = W.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for k in range(j - i):
            yield np.unique(W.shingles(hashes[first[k] : first[k + 1]]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, d1, d2 (digest of the set), s1, s2 (sketch bits), bands."""

    def run(batches):
        for batch in batches:
            n, digest, bits, bands = [], [], [], []
            for items in sets(batch.column("text")):
                n.append(len(items))
                digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                if len(items):
                    s = sketch(items)
                    bits.append(np.packbits((W.mix(s) & U64(1)).astype(bool)).tobytes())
                    bands.append(band_keys(s).astype(np.int64))
                else:
                    bits.append(bytes(16))
                    bands.append(None)
            d, s = (np.frombuffer(b"".join(x), np.int64).reshape(-1, 2) for x in (digest, bits))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in (d[:, 0], d[:, 1], s[:, 0], s[:, 1])), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n", "d1", "d2", "s1", "s2", "bands"],
            )

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return rows.mapInArrow(run, "doc_id long, text_key long, n long, d1 long, d2 long, s1 long, s2 long, bands array<long>")


def _positions(column, bits: int):
    return F.explode(F.array(*(F.pmod(F.xxhash64(column, F.lit(k)), F.lit(bits)) for k in range(4))))


def bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column doc_id, as 64-bit words."""
    out = np.zeros(-(-bits // 64), np.int64)
    words = ids.select(_positions(F.col("doc_id"), bits).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    for row in words.toLocalIterator():  # MOST_FILTER_BITS at most
        out[row["w"]] = row["bits"]
    return out


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, items of (at least) the documents whose id is among ids.

    The second scan computes sets only where a Bloom filter hits, as long as the filter can tell the ids apart;
    more ids are joined by shuffle, so that no other document's set is made.
    """
    n, rows = ids.count(), texts(docs).filter("doc_id is not null and text is not null")

    def made(batch):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(np.int64) for x in sets(batch.column("text"))], pa.list_(pa.int64()))], ["doc_id", "items"])

    if 16 * n > MOST_FILTER_BITS:
        return rows.join(ids, "doc_id", "left_semi").mapInArrow(lambda batches: map(made, batches), "doc_id long, items array<long>")
    bits = max(1024, 16 * n)
    held = docs.sparkSession.sparkContext.broadcast(bloom(ids, bits))

    def run(batches):
        member = held.value
        for batch in batches:
            hit = np.ones(batch.num_rows, bool)
            for k in range(4):
                p = np.asarray(batch.column(f"p{k}"))
                hit &= (member[p // 64] >> (p % 64)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            if batch.num_rows:
                yield made(batch)

    rows = rows.select("*", *(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(bits)).alias(f"p{k}") for k in range(4)))
    return rows.mapInArrow(run, "doc_id long, items array<long>")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough, after the bounds that sizes and sketch bits give."""
    brief = nodes.select("doc_id", "n", "s1", "s2")
    a, b = (brief.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "s1", "s2"))) for x in "ab")
    pairs = cut(pairs.join(a, "a").join(b, "b").filter(close("n_a", "n_b", "s1_a", "s1_b", "s2_a", "s2_b")).select("a", "b"))
    if pairs.isEmpty():
        return pairs
    items = cut(full_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()))
    # the least document of many has its set in several parts of its star
    hot = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")).filter("chunks > 1"))
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    one = F.coalesce("chunks", F.lit(1).cast("long"))
    left = items.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    left = left.join(hot, "a", "left").select("a", "x", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("part"))
    right = pairs.join(hot, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), one).alias("part")).join(items.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    similar = shared * DEN >= NUM * (F.size("x") + F.size("y") - shared)
    return cut(right.join(left, ["a", "part"]).filter(similar).select("a", "b").distinct())


def close(n_a, n_b, s1_a, s1_b, s2_a, s2_b):
    apart = F.bit_count(F.col(s1_a).bitwiseXOR(F.col(s1_b))) + F.bit_count(F.col(s2_a).bitwiseXOR(F.col(s2_b)))
    return (apart <= MOST_BITS) & (F.col(n_a) * DEN >= F.col(n_b) * NUM) & (F.col(n_b) * DEN >= F.col(n_a) * NUM)


def across(rows: DataFrame, *more: str, condition=None) -> DataFrame:
    """Pairs of rows (band, doc_id, root, n, s1, s2, chunks and more) of one band and different roots that sizes, sketch bits and the condition allow.

    A band's members lie in ``chunks`` parts by a hash; each pair of parts is a group of its own, so that a hot band's pairs are many tasks' work.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))
    a, b = (rows.select("band", *(F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "root", "n", "s1", "s2", *more)), part.alias(x), other.alias("a" if x == "b" else "b")) for x in "ab")
    on = (a["band"] == b["band"]) & (a["a"] == b["a"]) & (a["b"] == b["b"]) & (F.col("root_a") < F.col("root_b")) & close("n_a", "n_b", "s1_a", "s1_b", "s2_a", "s2_b")
    return a.join(b, on if condition is None else on & condition)


def links_across(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between the components in large buckets, without a row for each pair that might be one.

    Shingles that no other component has cannot be shared across components. So a document that has
    fewer than NUM / DEN of its shingles in common with other components has no such link and goes; the edits of
    loose copies of one text are such shingles. For the rest the join's own condition bounds each pair by
    these counts, then compares the full sets; only links leave it.
    """
    if rows.isEmpty():
        return rows.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    own = rows.select("doc_id", "root", "n", "s1", "s2").distinct()
    items = cut(full_sets(docs, own.select("doc_id").distinct()).join(own, "doc_id").filter(F.size("items") == F.col("n")))
    each = items.select("doc_id", "root", F.explode("items").alias("item"))
    common = each.groupBy("item").agg((F.min("root") != F.max("root")).alias("common")).filter("common").drop("common")
    shared = each.join(common, "item").groupBy("doc_id").agg(F.count("*").alias("c")).join(items, "doc_id").filter(F.col("c") * DEN >= F.col("n") * NUM)
    open_rows = cut(rows.select("band", "doc_id").join(shared.drop("items"), "doc_id"))
    chunks = cut(open_rows.groupBy("band").agg(F.ceil(F.count("*") / CHUNK).cast("long").alias("chunks")))
    open_rows = open_rows.join(chunks, "band").join(items.select("doc_id", "items"), "doc_id")
    least = lambda c: F.col(c) * (DEN + NUM) >= NUM * (F.col("n_a") + F.col("n_b"))
    both = F.size(F.array_intersect("items_a", "items_b"))
    found = across(open_rows, "c", "items", condition=least("c_a") & least("c_b") & (both * (DEN + NUM) >= NUM * (F.col("n_a") + F.col("n_b"))))
    return cut(found.select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct())


def components(links: DataFrame) -> DataFrame:
    """doc_id, root: the least id reachable, for every id in links (a, b). Large and small stars in turn, until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = edges.count(), None
    while True:
        few = lambda df, n=max(1, -(-state[0] // TASK_LINKS)): df.coalesce(n)  # noqa: E731  tasks follow the links, not the session's setting
        now = few(edges)
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = few(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = few(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        edges = cut(few(small.distinct()))
        found = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if found == state:
            break
        state = found
    roots = edges.select(F.col("v").alias("doc_id"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("doc_id"), F.col("v").alias("root")).unionAll(roots)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, text_key (xxhash64 of the text), n_shingles, component_id, kept."""
    prints = cut(fingerprints(docs))
    nodes = cut(
        prints.filter("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("n", "s1", "s2", "bands")))
    )
    keys = nodes.select(F.explode("bands").alias("band"), "doc_id")
    buckets = cut(keys.groupBy("band").agg(F.min("doc_id").alias("least"), F.count("*").alias("members")).filter("members > 1").drop("members"))
    members = cut(keys.join(buckets, "band"))

    links = verified(docs, members.filter("doc_id <> least").select(F.col("least").alias("a"), F.col("doc_id").alias("b")).distinct(), nodes)
    roots = cut(components(links))

    placed = members.join(roots, "doc_id", "left").select("band", "doc_id", "least", F.coalesce("root", "doc_id").alias("root"))
    mixed = cut(placed.groupBy("band").agg((F.min("root") != F.max("root")).alias("mixed"), (F.count("*") <= SMALL).alias("small")).filter("mixed").drop("mixed"))
    open_rows = cut(placed.join(mixed, "band").filter("doc_id <> least").join(nodes.select("doc_id", "n", "s1", "s2"), "doc_id"))
    few = across(open_rows.filter("small").withColumn("chunks", F.lit(1).cast("long"))).select(F.col("doc_id_a").alias("a"), F.col("doc_id_b").alias("b")).distinct()
    more = verified(docs, few, nodes).unionAll(links_across(docs, cut(open_rows.filter("not small"))))
    roots = cut(components(links.unionAll(more)))

    # only classes of several documents or with links differ from their documents; these few rows are joined to all
    classes = nodes.join(roots, "doc_id", "left").filter("copies > 1 or root is not null").select("d1", "d2", F.coalesce("root", "doc_id").alias("root"))
    found = prints.select("doc_id", "text_key", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near duplicates, all columns as they were; of repeated rows of one id and text one stays; rows with a null id all stay.

    Only keys of rows that go, or that are repeated, meet the rows: broadcast when counted to be few, else by shuffle.
    """
    found = cut(near_duplicates(docs).filter("doc_id is not null").select("doc_id", "text_key", "kept").groupBy("doc_id", "text_key").agg(F.min("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"))
    names = docs.columns
    lower = [n.lower() for n in names]
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    rows = rows.withColumn("row_id", F.col(f"c{lower.index('doc_id')}").cast("long")).withColumn("row_key", F.xxhash64(F.col(f"c{lower.index('text')}").cast("string")))

    def met(rows, keys, how):
        keys = keys.select(F.col("doc_id").alias("row_id"), F.col("text_key").alias("row_key"))
        return rows.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, ["row_id", "row_key"], how)

    gone, repeated = found.filter("not kept"), found.filter("kept")
    rows = met(rows, gone, "left_anti")
    if not repeated.isEmpty():
        rows = met(rows, repeated, "left_anti").unionByName(met(rows, repeated, "left_semi").dropDuplicates(["row_id", "row_key"]))
    return rows.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_key")
