"""Words and word shingles of whole Arrow batches as numpy arrays (small helpers used inside Spark tasks)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
_U = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(0, 2**64, 256, dtype=_U)
BASE = _U(0x9E3779B97F4A7C15)
BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
PIECE = 1 << 20  # bytes that a task works on at a time
LONG_WORD = 64  # bytes beyond which words are hashed one by one


def small_batches(spark) -> None:
    """Arrow batches of bounded bytes for Python workers, unless the session sets its own."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(key) in ("10000", "67108864", "-1", str(256 << 20), str((1 << 31) - 1)):  # the defaults
            spark.conf.set(key, value)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    p = np.full(n, base, _U)
    p[:1] = 1
    return np.cumprod(p)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (n + 1) and bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0]:at[-1]]


def slices(offsets: np.ndarray, most_bytes: int = PIECE, most_rows: int = 4096):
    """(first row, end row) of runs of documents of bounded total size; one document is never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1
        j = min(max(j, i + 1), i + most_rows, n)
        yield i, j
        i = j


def word_spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first byte and end byte of every word, in order; words never cross documents."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    starts = np.flatnonzero(word & (~before | cut[:-1]))
    ends = np.flatnonzero(word & (~after | cut[1:])) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, equal for equal words anywhere: eight bytes a round, scrambled each time."""
    size = ends - starts
    h = mix(size.astype(_U) + _U(0x51ED270B))
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    todo = np.flatnonzero(size <= LONG_WORD)
    for k in range(0, LONG_WORD, 8):
        todo = todo[size[todo] > k]
        if not len(todo):
            break
        rest = np.minimum(size[todo] - k, 8).astype(_U)
        chunk = eights[starts[todo] + k] & (~_U(0) >> (_U(64) - _U(8) * rest))
        h[todo] = mix((h[todo] ^ mix(chunk + BASE)) * BASE + _U(k + 1))
    far = np.flatnonzero(size > LONG_WORD)
    if len(far):
        h[far] = mix(np.array([xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes()) for k in far], _U) ^ h[far])
    return h


def _space_from(data: np.ndarray, at: int, piece: int) -> int:
    """The first place from ``at`` on where no word is cut."""
    while at < len(data):
        space = np.flatnonzero(SPACE[data[at:at + piece]])
        if len(space):
            return at + int(space[0])
        at += piece
    return len(data)


def word_cuts(data: np.ndarray, piece: int = PIECE):
    """(first byte, end byte) of consecutive pieces of one text that cut no word; a word longer than ``piece`` stays whole."""
    lo = 0
    while lo < len(data):
        hi = _space_from(data, lo + piece, piece)
        yield lo, hi
        lo = hi


def word_pieces(data: np.ndarray, overlap: int, piece: int = PIECE):
    """(first byte, end byte, number of the first word, starts, ends) of pieces of one text that share ``overlap`` words."""
    lo, word0, want = 0, 0, piece
    while True:
        hi = _space_from(data, lo + want, piece)
        _, starts, ends = word_spans(np.array([0, hi - lo]), data[lo:hi])
        if hi < len(data) and len(starts) <= overlap:
            want *= 2
            continue
        yield lo, hi, word0, starts, ends
        if hi == len(data):
            return
        step = len(starts) - overlap
        word0, lo, want = word0 + step, lo + int(starts[step]), piece


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The text with one space after each word, and where words start and end in it."""
    keep = ~SPACE[data]
    text = np.where(keep, data, np.uint8(0x20))
    keep[ends[ends < len(data)]] = True
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return text[keep].tobytes(), at[starts], at[ends]


def runs(keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal neighbours."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _shingles(doc: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, hash) of each run of ``width`` words inside one document, by its first word."""
    m = len(h) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(doc[:m] == doc[width - 1:])
    span = np.zeros(len(at), _U)
    for k in range(width):
        span = mix(span * BASE + h[at + k] + _U(k + 1))
    return at, span


def _short(h: np.ndarray) -> np.ndarray:
    """The hash of a sequence of words as a whole."""
    span = mix(np.array([len(h)], _U))
    for x in h:
        span = mix(span * BASE + x)
    return span


def shingle_sets(offsets: np.ndarray, data: np.ndarray, width: int, lower: bool = True, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """(document, 52-bit hash) of the distinct word shingles of each document, sorted; at most 4096 documents.

    A document with fewer words than ``width`` has its whole sequence as its one shingle; one without words has none. A single
    document longer than ``piece`` is worked piece by piece.
    """
    if lower:
        data = LOWER[data]
    if len(offsets) == 2 and len(data) > piece:
        tail, parts = np.zeros(0, _U), []
        for lo, hi in word_cuts(data, piece):
            _, starts, ends = word_spans(np.array([0, hi - lo]), data[lo:hi])
            h = np.r_[tail, word_hashes(data[lo:hi], starts, ends)]
            parts.append(np.unique(_shingles(np.zeros(len(h), np.int64), h, width)[1] >> _U(12)))
            tail = h[max(0, len(h) - width + 1):]
        key = np.unique(np.concatenate(parts))
        if not len(key) and len(tail):
            key = _short(tail) >> _U(12)
        return np.zeros(len(key), np.int64), key
    doc, starts, ends = word_spans(offsets, data)
    h = word_hashes(data, starts, ends)
    at, span = _shingles(doc, h, width)
    words = np.bincount(doc, minlength=len(offsets) - 1)
    first = runs(doc)
    few = [k for k in first if words[doc[k]] < width]
    lone = np.concatenate([_short(h[k:k + words[doc[k]]]) for k in few]) if few else np.zeros(0, _U)
    key = np.unique((np.r_[doc[at], doc[few]].astype(_U) << _U(52)) | (np.r_[span, lone] >> _U(12)))
    return (key >> _U(52)).astype(np.int64), key & _U((1 << 52) - 1)
