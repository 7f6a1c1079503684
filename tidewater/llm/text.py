"""Vectorised word hashing over Arrow text columns.

Words are maximal runs of ``[^\\x20\\x09-\\x0D]``. All white space of that class is ASCII, so it can
be found in the UTF-8 bytes without decoding. A word is known by a 64-bit hash; every function
here works on whole texts and holds at most ``BLOCK`` bytes (or one longer word) of wide
temporaries at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; eight-byte temporaries make this 8 MB each.
BLOCK = 1 << 20

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)
_MULT = 0xD1342543DE82EF95
_INV = pow(_MULT, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * _STEP)
TABLE_RAW = _TABLE.copy()
TABLE_LOWER = _TABLE.copy()
TABLE_LOWER[65:91] = _TABLE[97:123]

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse, kept for the next call."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BLOCK)
        for name, base in (("up", _MULT), ("down", _INV)):
            out = np.empty(size, U64)
            out[0] = 1
            done, jump = 1, base
            while done < size:
                take = min(done, size - done)
                out[done : done + take] = out[:take] * U64(jump)
                done, jump = done + take, jump * jump % (1 << 64)
            _powers[name] = out
    return _powers["up"][:n], _powers["down"][:n]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its offsets, len + 1 of them from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Where data is cut into blocks: at ends of texts, or at white space within one longer than BLOCK."""
    cuts, at, total = [0], 0, len(data)
    while at < total:
        end = at + BLOCK
        if end >= total:
            end = total
        else:
            text_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if text_end > at:
                end = text_end
            else:
                limit = int(offsets[np.searchsorted(offsets, at, "right")])
                gap = np.flatnonzero(SPACE[data[at + 1 : min(end, limit)]])
                while not len(gap) and end < limit:
                    end = min(end + BLOCK, limit)
                    gap = np.flatnonzero(SPACE[data[at + 1 : end]])
                end = at + 1 + int(gap[-1]) if len(gap) else limit
        cuts.append(end)
        at = end
    return cuts


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = TABLE_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, text after text, and len(texts) + 1 offsets into them.

    ``table`` gives the byte values: TABLE_LOWER lower-cases A-Z, TABLE_RAW does not.
    """
    cuts = _cuts(data, offsets)
    hashes, starts_all = [], []
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        word = ~SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        heads = offsets[np.searchsorted(offsets, a, "left") : np.searchsorted(offsets, b, "left")] - a
        first[heads] = word[heads]
        last = word.copy()
        last[:-1] &= ~word[1:]
        tails = heads[heads > 0] - 1
        last[tails] = word[tails]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            up, down = _power(len(part))
            total = np.cumsum(table[part] * up)
            value = total[e]
            inner = s > 0
            value[inner] -= total[s[inner] - 1]
            hashes.append(mix(value * down[s] + (e - s + 1).astype(U64) * _STEP))
            starts_all.append(s + a)
    if not hashes:
        return np.empty(0, U64), np.zeros(len(offsets), np.int64)
    starts = np.concatenate(starts_all)
    return np.concatenate(hashes), np.searchsorted(starts, offsets, "left")


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the word windows of one text; fewer words make one window, none make none."""
    n = len(words)
    if n == 0:
        return np.empty(0, U64)
    span = min(n, width)
    with np.errstate(over="ignore"):
        value = np.full(n - span + 1, span, U64)
        for k in range(span):
            value = value * U64(_MULT) + words[k : n - span + 1 + k]
    value = np.sort(mix(value))
    if len(value) > 1:
        value = value[np.concatenate(([True], value[1:] != value[:-1]))]
    return value


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 22):
    """Parts of a batch, each of about ``limit`` bytes of the column or of one row."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = column_sizes(values)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def column_sizes(values: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64)
