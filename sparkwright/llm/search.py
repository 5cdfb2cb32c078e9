"""Exact top-k search: exhaustive term-at-a-time accumulation in blocks.

A component of a vector is a term, its value in a candidate the posting's weight.
Queries are taken in chunks of at most CHUNK_BYTES, each sent to all tasks; candidates are read
where they lie, without a shuffle, in blocks of at most BLOCK_BYTES. A block's posting lists
are made once. For each term, the query rows that have it scatter their weight times the posting
list into a dense score array (queries by candidates). Partition selection keeps the best of each query
in the block, which are merged into the task's lists; a window merges the tasks' lists.

A query's own row is one of the candidates, so that one more than k are kept, and one entry with
the query's id and the score of the query with itself goes if it is among them: rows of equal id and
score give equal results, whichever of them goes. Equal queries are searched for once and returned each.

Defined results: vectors null, with null or with non-finite components take no part; a vector of another length
than the query's scores over the components that both have; a null vec_id takes no part; repeated vec_ids are
candidates each, also for one another, and queries each, with ranks of their own; ties go to the smaller vec_id; only vec_id and
embedding are read, whatever other columns there are; an empty table gives no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import cut, documents

#: Bytes of queries sent at once; of a block of candidates; of the dense score array.
CHUNK_BYTES, BLOCK_BYTES, SCORE_BYTES = 16 << 20, 4 << 20, 1 << 20


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v (array of long) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    finite = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite).select("vec_id", F.transform("x", lambda x: F.floor(x * scale)).alias("v"))


def matrix(lists) -> np.ndarray:
    """An Arrow column of lists as rows of one width, with zeros where a list is shorter."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
    at, size = at - at[0], np.diff(at)
    width = int(size.max()) if len(size) else 0
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1], size)] = flat
    return out


def postings(candidates: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term the candidates that have it (None: all) and their weights."""
    out = []
    for column in np.ascontiguousarray(candidates.T):
        have = np.flatnonzero(column)
        out.append((None, column) if len(have) == len(column) else (have, column[have]))
    return out


def accumulate(queries: np.ndarray, lists, n: int) -> np.ndarray:
    """Integer inner products of queries and n candidates, term at a time."""
    scores = np.zeros((len(queries), n), np.int64)
    for weights, (have, values) in zip(queries.T, lists, strict=False):
        rows = np.flatnonzero(weights)
        if have is None and len(rows) == len(weights):
            scores += weights[:, None] * values
        elif len(rows) and len(values):
            at = np.ix_(rows, np.arange(n) if have is None else have)
            scores[at] += weights[rows, None] * values
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, equal = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        need = k - len(above)
        if len(equal) > need:
            equal = equal[np.argpartition(ids[equal], need - 1)[:need]]
        places = np.concatenate([above, equal])
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))]


class Lists:
    """The k best candidates so far of each of n queries; empty places have found False."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores, self.found = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def merge(self, query: int, ids: np.ndarray, scores: np.ndarray):
        own = self.found[query]
        if own.all() and scores.max(initial=np.iinfo(np.int64).min) < self.scores[query].min():
            return
        places = best(scores, ids, self.k)
        ids, scores = np.concatenate([self.ids[query][own], ids[places]]), np.concatenate([self.scores[query][own], scores[places]])
        places = best(scores, ids, self.k)
        self.ids[query, : len(places)], self.scores[query, : len(places)], self.found[query, : len(places)] = ids[places], scores[places], True


def chunks(queries: DataFrame):
    """Distinct queries in bounded parts, by ranges of a hash: ids, times that each occurs, vectors."""
    n, size = queries.agg(F.count("*"), F.sum(F.size("v") * 8 + 24)).first()
    parts = -(-int(size or 0) // CHUNK_BYTES)
    queries = cut(queries.groupBy("vec_id", "v").agg(F.count("*").alias("times")))  # a query and its hash stay the same in all scans
    for k in range(parts):
        own = queries.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts)) == k).toArrow().sort_by([("vec_id", "ascending")])
        if own.num_rows:
            yield np.asarray(own["vec_id"]), np.asarray(own["times"]), matrix(own["v"])


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates; both inputs as from quantised(), queries being among the candidates."""
    sc, out = queries.sparkSession.sparkContext, None
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    for ids, times, vectors in chunks(queries):
        held = sc.broadcast((ids, vectors))

        def run(batches, held=held):
            q_ids, q = held.value
            lists, seen = Lists(len(q), k + 1), False
            for batch in batches:
                c_ids, c = np.asarray(batch.column("vec_id")), matrix(batch.column("v"))
                step = max(1, BLOCK_BYTES // (8 * max(1, c.shape[1])))
                for i in range(0, len(c), step):
                    seen = True
                    own, part = c_ids[i : i + step], postings(c[i : i + step])
                    rows = max(1, SCORE_BYTES // (8 * len(own)))
                    for j in range(0, len(q), rows):
                        for query, scores in enumerate(accumulate(q[j : j + rows], part, len(own)), j):
                            lists.merge(query, own, scores)
            if seen:
                query, place = np.nonzero(lists.found)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (query, lists.ids[query, place], lists.scores[query, place])], ["query", "vec_id", "score"])

        found = candidates.mapInArrow(run, "query long, vec_id long, score long")
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
        asked = queries.sparkSession.createDataFrame(pa.table({"query": np.arange(len(ids)), "query_id": ids, "times": times, "self": (vectors * vectors).sum(axis=1)}))
        found = found.join(F.broadcast(asked), "query")  # of a chunk, so bounded
        own = (F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("self"))
        first = F.min(F.when(own, F.col("rank"))).over(Window.partitionBy("query"))  # one of its own entries goes
        found = found.withColumn("own", first).filter("own is null or rank <> own").withColumn("rank", F.when(F.col("rank") > F.col("own"), F.col("rank") - 1).otherwise(F.col("rank"))).filter(F.col("rank") <= k)
        found = found.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("query_id", "rank", "vec_id", "score")
        out = found if out is None else out.unionAll(found)
    return queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quantised(documents(spark, sf_dir, "embeddings"))
    return top_k(rows.filter("vec_id % 50 = 0"), rows)


OP7_SQL = """
WITH q AS (
  SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row_id AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.row_id <> b.row_id WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
