"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but ids of fixed width, each document ended by one separator.
It is read by offset in ranges of RANGE_BLOCKS blocks, so that no file is one task's and none is too
long. A block of BLOCK_TOKENS ids, cut anywhere, is searched for the separator at once (vectorised). Its row has
the lengths between its separators, how many there are and where the last one stands in the file. A prefix scan
over the blocks (the number of separators and the greatest place so far) stitches the boundaries: a document that
ends in a block began after the last separator of an earlier block, and its number is that of the separators before it. The
scan has two levels, of SPAN blocks and of spans, so that a file of any length is not one task's group.

``write_flat`` makes such files of a corpus in the folder that all executors share: each task writes one
file of its own name as it encodes, and only the names that successful tasks return are read.
Files are opened by pyarrow's file systems (local or mounted paths, hdfs, s3, gs).

Counts leave out the separator. Tokens after the last separator of a file are one more
document, with ``closed`` false. Defined results: an empty file has no documents; two
separators in a row enclose a document of 0 tokens; a file whose size is no multiple of the id's width, and a
separator that is a rank of the vocabulary, raise an error. ``op9``: null and empty texts have 0 tokens;
null doc_ids and repeated rows have a result each; texts of any length and ids that tie need nothing special; only
doc_id and text are read, whatever other columns there are; an empty table gives no rows.
"""

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import bpe
from .shared import cut, documents, folder, texts

SEPARATOR = 50256
BLOCK_TOKENS, RANGE_BLOCKS, SPAN = 1 << 16, 64, 1024
#: Ranges that a task of the scan gets.
TASK_RANGES = 4
SCANNED = "file string, block long, n long, last long, lengths array<long>"


def opened(uri: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def scan_block(ids: np.ndarray, separator: int) -> tuple[np.ndarray, int | None]:
    """Tokens before each separator since the one before or the block's start; the last separator's place."""
    at = np.flatnonzero(ids == separator)
    return np.diff(at, prepend=-1) - 1, int(at[-1]) if len(at) else None


def scanned(files: DataFrame, separator: int, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """files: file, tokens. One small row for each block."""
    kind, blocks = {2: "<u2", 4: "<u4"}[width], RANGE_BLOCKS

    def run(batches):
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("range").to_pylist(), strict=True):
                system, path = opened(file)
                with system.open_input_file(path) as f:
                    f.seek(at * blocks * block_tokens * width)
                    ids = np.frombuffer(f.read(blocks * block_tokens * width), kind)
                base, found = at * blocks, [scan_block(ids[k : k + block_tokens], separator) for k in range(0, len(ids), block_tokens)]
                last = [None if x is None else (base + k) * block_tokens + x for k, (_, x) in enumerate(found)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(found)), pa.array(np.arange(base, base + len(found))), pa.array([len(x) for x, _ in found], pa.int64()), pa.array(last, pa.int64()), pa.array([x for x, _ in found], pa.list_(pa.int64()))],
                    ["file", "block", "n", "last", "lengths"],
                )

    step = block_tokens * blocks
    total = files.agg(F.sum(F.ceil(F.col("tokens") / step))).first()[0] or 0
    ranges = files.filter("tokens > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / step))).alias("range"))
    return ranges.repartition(max(1, -(-int(total) // TASK_RANGES)), "file", "range").mapInArrow(run, SCANNED)


def stitched(blocks: DataFrame) -> DataFrame:
    """Adds ``before``, the separators in the file's earlier blocks, and ``since``, the place of the last of them (-1: none)."""
    rows = blocks.withColumn("span", F.floor(F.col("block") / SPAN))
    earlier = lambda window: window.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("file", "span").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    over = earlier(Window.partitionBy("file").orderBy("span"))
    spans = spans.select("file", "span", F.sum("n").over(over).alias("span_n"), F.max("last").over(over).alias("span_last"))
    within = earlier(Window.partitionBy("file", "span").orderBy("block"))
    rows = rows.withColumn("own_n", F.sum("n").over(within)).withColumn("own_last", F.max("last").over(within)).join(spans, ["file", "span"])
    zero = F.lit(0).cast("long")
    return rows.select("file", "block", "n", "last", "lengths", (F.coalesce("own_n", zero) + F.coalesce("span_n", zero)).alias("before"), F.coalesce("own_last", "span_last", F.lit(-1).cast("long")).alias("since"))


def counts(blocks: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, document (from 0), n_tokens of every closed document."""
    one = stitched(blocks).filter("n > 0").select("file", "block", "before", "since", F.posexplode("lengths").alias("place", "own"))
    first = F.col("block") * block_tokens + F.col("own") - F.col("since") - 1
    return one.select("file", (F.col("before") + F.col("place")).alias("document"), F.when(F.col("place") == 0, first).otherwise(F.col("own")).alias("n_tokens"))


def token_counts(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, document (from 0), n_tokens, closed of every document of the flat token files at path."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")  # the listing only: contents are not read
    files = files.filter((F.col("length") % width == 0) | F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("file"))).cast("boolean"))
    files = files.select("file", (F.col("length") / width).cast("long").alias("tokens"))
    blocks = cut(scanned(files, separator, width, block_tokens))
    ends = blocks.groupBy("file").agg(F.sum("n").alias("document"), F.max("last").alias("last"))
    rest = files.join(ends, "file").select("file", "document", (F.col("tokens") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return counts(blocks, block_tokens).withColumn("closed", F.lit(True)).unionAll(rest)


def write_flat(docs: DataFrame, at: str, ranks_path: str, pattern: str, separator: int = SEPARATOR) -> tuple[DataFrame, int]:
    """Writes a corpus as flat token files in the folder ``at``. Rows file, first, tokens, doc_ids: documents from number ``first`` on, and their tokens with separators; and the ids' width."""
    raw = bpe.rank_file(ranks_path)
    ranks = set(bpe.load_ranks(raw).values())
    if separator in ranks:
        raise ValueError(f"the separator {separator} is the id of a token")
    width = 2 if max(max(ranks, default=0), separator) < 1 << 16 else 4
    raw = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches):
        codec, out, first = bpe.Codec(raw.value, pattern), None, 0
        file = f"{at}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bin"
        for batch in batches:
            if out is None:
                system, path = opened(file)
                system.create_dir(path.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(path)
            tokens = 0
            for text in batch.column("text"):
                ids = np.array([*codec.encode(text.as_py()), separator], f"<u{width}")
                out.write(ids.tobytes())
                tokens += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([first]), pa.array([tokens]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64()))], ["file", "first", "tokens", "doc_ids"])
            first += batch.num_rows
        if out is not None:
            out.close()

    return cut(texts(docs).mapInArrow(run, "file string, first long, tokens long, doc_ids array<long>")), width


def documents_counted(docs: DataFrame, ranks_path: str, pattern: str, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, n_tokens, file, document of a corpus: written as flat files, counted by the scan of these."""
    at = f"{folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    written, width = write_flat(docs, at, ranks_path, pattern, separator)
    found = counts(cut(scanned(written.groupBy("file").agg(F.sum("tokens").alias("tokens")), separator, width)))
    names = written.select("file", "first", F.posexplode("doc_ids").alias("place", "doc_id")).select("file", (F.col("first") + F.col("place")).alias("document"), "doc_id")
    return found.join(names, ["file", "document"]).select("doc_id", "n_tokens", F.substring_index("file", "/", -1).alias("file"), "document")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return documents_counted(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
