"""Vectorised word scanning over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; A-Z count as a-z.
Words become 64-bit hashes, so that shingles and n-grams are arithmetic on arrays.
All functions are pure; nulls read as empty text.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once: bounds a worker's temporary arrays at about 40 times this.
SLICE_BYTES = 1 << 20

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BYTE[65:91] = _BYTE[97:123]
_STEP = U64(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(1, 2**63, 8, dtype=np.uint64) | U64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES):
    """Row ranges of about ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the index of its first word (n + 1 entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~SEPARATOR[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[0] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(start)
    del start
    if not len(starts):
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    kept = data[inside]
    # in the compacted bytes, a word begins after the separators that stand before it
    skipped = np.cumsum(~inside, dtype=np.int32 if n < 2**31 else np.int64)
    begin = starts - skipped[starts]
    lengths = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept), dtype=np.int64) - np.repeat(begin, lengths)
    longest = int(lengths.max())
    power = np.full(longest, _STEP, U64)
    power[0] = U64(1)
    np.multiply.accumulate(power, out=power)
    hashes = mix(np.add.reduceat(_BYTE[kept] * power[place], begin) + lengths.astype(U64))
    return hashes, np.searchsorted(starts, offsets)


def counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    n = len(data)
    if not n:
        return np.zeros(len(offsets) - 1, np.int64)
    inside = ~SEPARATOR[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    start[first] |= inside[first]
    return np.diff(np.append(0, np.cumsum(start, dtype=np.int64))[offsets])


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` words in a row, without regard to the texts' ends; shorter input gives none."""
    m = len(hashes) - size + 1
    if m <= 0:
        return np.zeros(0, U64)
    total = hashes[:m] * _PLACE[0]
    for k in range(1, size):
        total = total + hashes[k : k + m] * _PLACE[k]
    return mix(total + U64(size))


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash of a whole short sequence of words (fewer than a shingle has)."""
    return mix((hashes * _PLACE[: len(hashes)]).sum(dtype=U64, keepdims=True) + U64(len(hashes)))


def shingles(hashes: np.ndarray, size: int = 5) -> np.ndarray:
    """The shingles of one text in order, repeats included: with fewer words the whole sequence, without words none."""
    if len(hashes) >= size:
        return runs(hashes, size)
    return whole(hashes) if len(hashes) else np.zeros(0, U64)
