"""Words, their numbers and rolling hashes of whole Arrow text columns, without loops over words.

A word is a run of code points other than U+0020 and U+0009..U+000D. All of
these are single bytes in UTF-8, so everything works on the column's bytes.
Words are told apart by their bytes (codes()). Hashes of several words only
choose and place; what must be exact compares codes or digests of the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Odd multiplier of the rolling hash.
BASE = 0x9E3779B97F4A7C15
SEED = 42
_powers: dict[tuple[int, bool], np.ndarray] = {}


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer text is a range of its own."""
    _, off = buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start byte, end byte and row of each word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, word[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or those of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        have = np.full(max(n, 1 << 16), U(step))
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        if n > 8 << 20:
            return have
        _powers[base, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each word among the distinct words of `data`, compared by their bytes, and these words."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    off = np.concatenate(([0], np.cumsum(ends - starts)))
    plain = data[~_IS_SPACE[data]]
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(plain)])
    found = column.dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 of each word."""
    code, distinct = codes(data, starts, ends)
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in distinct.to_pylist()), U, len(distinct))[code]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of `data` with one space between those of a row, and where each now starts and ends."""
    space = _IS_SPACE[data]
    stays = ~space
    behind = ends[ends < len(data)]
    stays[behind] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(stays, out=at[1:])
    return np.where(space, np.uint8(0x20), data)[stays].tobytes(), at[starts], at[ends]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each values[start:end]. Modulo 2**64, so unequal sequences may well share one."""
    total = np.zeros(len(values) + 1, dtype=U)
    np.cumsum(values * powers(BASE, len(values)), out=total[1:])
    return (total[ends] - total[starts]) * powers(BASE, len(values) + 1, inverse=True)[starts]


def gram_hashes(word: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each word on, and whether they lie in one row."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    at = np.arange(n)
    return mix(rolling(word, at, at + k)), rows[:n] == rows[k - 1 :]


#: Numbers of grams stay below.
MOST = 1 << 63


def _numbered(x: np.ndarray) -> np.ndarray:
    """Number of each value among the distinct ones, as they come."""
    return pa.array(x).dictionary_encode().indices.to_numpy().astype(np.int64)


def gram_codes(code: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact number of the k words from each word on (equal for equal words in one row), and whether they lie in one row."""
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    size = int(code.max()) + 1
    gram, most = rows[:n].astype(np.int64), int(rows.max()) + 1
    for i in range(k):
        if most * size >= MOST:
            # Both numbers are below the number of words then, so the pair's fits.
            gram, most = _numbered(gram), n
        gram, most = gram * size + code[i : i + n], most * size
    return _numbered(gram), rows[:n] == rows[k - 1 :]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each x[i:i+width]."""
    have, size = x, 1
    while size * 2 <= width:
        have = np.minimum(have[:-size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
