"""Array kernels over the bytes of Arrow text columns (used inside tasks).

Texts are handled a few hundred kilobytes at a time (one longer text is one
piece), so a task's memory does not depend on its number of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 19

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection on 64-bit integers."""
    x = np.asarray(x, U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


BYTE = stream(256, 1)

_ALL = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, other bytes as they are
LOWERED = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)
SAME = _ALL.copy()
#: bytes of ``[^\x20\x09-\x0D]``
NOT_SPACE = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)


def pieces(col: pa.Array, limit: int = PIECE):
    """Cut a string or binary column: ``(first row, end row, bytes, offsets)``; a null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def spans(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of member bytes; a run never crosses two texts."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    start = member.copy()
    start[1:] &= ~member[:-1] | cut[1:n]
    end = member.copy()
    end[:-1] &= ~member[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owner(at: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The text of each byte position."""
    return np.searchsorted(offs, at, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span (spans are ordered and disjoint)."""
    if not len(start):
        return np.zeros(0, U64)
    size = end - start
    first = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=first[1:])
    at = np.arange(first[-1], dtype=np.int64)
    within = at - np.repeat(first[:-1], size)
    byte = data[within + np.repeat(start, size)]
    odd = stream(int(size.max(initial=1)), 2 + seed) | U64(1)
    with np.errstate(over="ignore"):
        terms = BYTE[byte] * odd[within]
        out = np.zeros(len(start), U64)
        full = size > 0
        if full.any():
            out[full] = np.add.reduceat(terms, first[:-1][full])
        return mix(out + size.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def words(data: np.ndarray, offs: np.ndarray, lower: np.ndarray, member: np.ndarray):
    """Hash, text and byte span of every word of a piece."""
    low = lower[data]
    start, end = spans(member[low], offs)
    return span_hash(low, start, end), owner(start, offs), start, end


def grams(h: np.ndarray, doc: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``k`` words from each word on, and where they lie in one text."""
    n = max(len(h) - k + 1, 0)
    weight = stream(k, seed) | U64(1)
    with np.errstate(over="ignore"):
        out = np.zeros(n, U64)
        for j in range(k):
            out += h[j:j + n] * weight[j]
    return mix(out), doc[:n] == doc[k - 1:k - 1 + n]


def ranks(doc: np.ndarray) -> np.ndarray:
    """The position of each entry within its (contiguous) text."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = np.r_[True, doc[1:] != doc[:-1]]
    first = np.flatnonzero(new)
    return np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))


def lists(doc: np.ndarray, n_docs: int, *values: np.ndarray) -> list[pa.Array]:
    """Arrow list columns of ``n_docs`` rows from values ordered by row."""
    offs = np.zeros(n_docs + 1, np.int32)
    np.cumsum(np.bincount(doc, minlength=n_docs), out=offs[1:])
    return [pa.ListArray.from_arrays(pa.array(offs), pa.array(v)) for v in values]


def text_udf(df, col: str, keep: list[str], schema: str, fn):
    """``mapInArrow`` over the whole texts of ``col``.

    ``fn(kept columns of the piece as a RecordBatch, bytes, offsets, valid)``
    returns a dict of columns for the piece, by ``schema``'s names.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for b in batches:
            c = b.column(len(keep))
            valid = np.ones(len(c), bool) if not c.null_count else np.asarray(c.is_valid())
            rest = b.select(list(range(len(keep))))
            for lo, hi, data, offs in pieces(c):
                out = fn(rest.slice(lo, hi - lo), data, offs, valid[lo:hi])
                if out is not None:
                    yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n]) for n in names], names=names)

    return df.select(*keep, col).mapInArrow(run, schema)
