"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut at safe boundaries before the regular expression sees them. A cut
stands before white space that follows a character other than white space: no match
of a pattern whose only white space is one leading space or a run of it spans that
place, and no match looks behind, so that the pieces' tokens are the text's tokens.
Decoding joins raw bytes, so any id sequence decodes, valid UTF-8 or not.

Defined results: null and empty texts have no ids; lone surrogates cannot occur in
Arrow strings; repeated rows give repeated results; of neighbours that tie in rank the leftmost merge first; texts of any
length are read whole; only doc_id and text are read, whatever other columns there are; an empty table gives no rows.
"""

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import texts

#: Characters of a piece after which the next safe boundary is taken.
PIECE_CHARS = 20_000
#: Bytes of one match beyond which merging by a heap is used, in n log n steps.
MERGE_BYTES = 4_000
#: A rank file is sent to the executors whole; larger ones are refused.
MOST_RANK_BYTES = 64 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: always merges the lowest-ranked neighbours, the leftmost of equals. Linked list and heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get(piece[i : end[after[j]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[j]]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Codec:
    def __init__(self, raw: bytes, pattern: str):
        import regex
        import tiktoken

        self.ranks = load_ranks(raw)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # Unicode's White_Space, which the library means by \s
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{space}").replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.boundary = re.compile(r"(?<=\S)(?=[ \t\n\r])")
        self.dense = re.compile(rf"\S{{{MERGE_BYTES // 4},}}|\s{{{MERGE_BYTES // 4},}}")

    def pieces(self, text: str):
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = self.boundary.search(text, at + PIECE_CHARS)
            if cut is None:
                break
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text or ""):
            if self.dense.search(piece):  # a match may be very long: quadratic merging and deep backtracking are avoided
                for match in self.pattern.finditer(piece):
                    word = match.group()
                    ids += merge(word.encode(), self.ranks) if len(word) > MERGE_BYTES // 4 else self.encoding.encode_ordinary(word)
            else:
                ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def rank_file(path: str) -> bytes:
    raw = open(path, "rb").read(MOST_RANK_BYTES + 1)
    if len(raw) > MOST_RANK_BYTES:
        raise ValueError(f"{path} is larger than {MOST_RANK_BYTES} bytes")
    return raw


def encoded(docs: DataFrame, ranks_path: str, pattern: str, ids: bool = True) -> DataFrame:
    """doc_id, ids (list of int), decoded (binary) of every text."""
    raw = docs.sparkSession.sparkContext.broadcast(rank_file(ranks_path))

    def run(batches):
        codec = Codec(raw.value, pattern)
        for batch in batches:
            all_ids = [codec.encode(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(all_ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in all_ids], pa.binary())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32 bit) and of the decoded bytes, made where the ids are."""
    raw = docs.sparkSession.sparkContext.broadcast(rank_file(ranks_path))

    def run(batches):
        codec = Codec(raw.value, pattern)
        for batch in batches:
            n, packed, decoded = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py())
                n.append(len(ids))
                packed.append(hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(packed, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, SCHEMA)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
