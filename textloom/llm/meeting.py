"""Where equal 64-bit hashes of a corpus meet: packed rows instead of a row a hash.

A map task turns an Arrow batch of documents into one row for each bucket of hashes, the hashes and what belongs to them packed into
byte strings; the rows are dealt by bucket; and a task sorts what has met in its buckets with numpy. Compared with a row a hash this
shuffles a third of the bytes in a fraction of the time. A caller must bound what one hash can send from one batch, so that hot hashes
don't fill a bucket: ngram_jaccard sends a few more than its limit of a hot shingle, chaining the first occurrence of a repeated seed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes a bucket, about.
LOAD = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: Bytes hashed at a time.
PIECE = 1 << 18
_rng = np.random.default_rng(77)
_BYTES = _rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_FACTOR = int(_rng.integers(1, 1 << 63)) * 2 + 1
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: dict[str, np.ndarray] = {}


def _powers_of(factor: int) -> np.ndarray:
    out = np.ones(PIECE + 1, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.uint64(factor)
        return np.multiply.accumulate(out)


def hashed_words(column) -> tuple[np.ndarray, np.ndarray]:
    r"""Of an Arrow column of texts: 64-bit hashes of all their words (between [\x20\x09-\x0D], A-Z in lower case), and where each text's
    begin (and the end). A word's hash is a polynomial over its bytes' random values, taken for all words at once from running sums."""
    import xxhash

    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, "<i4" if str(column.type) == "string" else "<i8")[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    space = _SPACE[text]
    edge = np.zeros(len(text) + 1, bool)  # a text begins here
    edge[offsets] = True
    starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]] ) | ~space & edge[:-1])
    ends = np.flatnonzero(~space & np.concatenate([space[1:], [True]]) | ~space & edge[1:]) + 1
    if not _powers:
        _powers.update(up=_powers_of(_FACTOR), down=_powers_of(pow(_FACTOR, -1, 1 << 64)))
    up, down = _powers["up"], _powers["down"]
    out, i = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            lo = starts[i]
            j = int(np.searchsorted(ends, lo + PIECE, side="right"))
            if j <= i:  # a word longer than a piece
                out[i] = xxhash.xxh3_64_intdigest(text[lo : ends[i]].tobytes().lower())
                i += 1
                continue
            some = text[lo : ends[j - 1]]
            sums = np.zeros(len(some) + 1, np.uint64)
            np.cumsum(_BYTES[some] * up[: len(some)], out=sums[1:])
            a, z = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mixed((sums[z] - sums[a]) * down[a] + (z - a).astype(np.uint64) * _MIX)
            i = j
    return out, np.searchsorted(starts, offsets)


def slices(batches, rows: int = 250):
    """The batches in parts of at most `rows` rows; at the end, what the task has freed goes back to the system, as workers are kept for later tasks."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
    released()


def released() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of h."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolled(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k successive words; of all words, if there are fewer (none: no hash)."""
    n = len(words)
    width = min(k, n)
    if not n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, width, np.uint64)
        for j in range(width):
            h = h * _MIX + words[j : n - width + 1 + j]
    return mixed(h)


def rolled_texts(words: np.ndarray, cuts: np.ndarray, k: int):
    """For each text, `rolled` of its words: those of many texts are rolled together."""
    together = rolled(words, k) if len(words) >= k else np.zeros(0, np.uint64)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield together[lo : hi - k + 1] if hi - lo >= k else rolled(words[lo:hi], k)


def buckets_for(hashes: int) -> int:
    return max(24, -(-hashes // LOAD))


def packed(hashes: np.ndarray, columns: dict[str, np.ndarray], buckets: int):
    """A record batch with a row a bucket: bucket, the hashes' low 48 bits (lo, hi) and the columns, in the order given."""
    import pyarrow as pa

    at = (hashes % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(buckets + 1))
    used = np.flatnonzero(np.diff(cuts))
    arrays = {"lo": (hashes & np.uint64(0xFFFFFFFF)).astype("<u4"), "hi": ((hashes >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2"), **columns}
    out = {"bucket": pa.array(used, pa.int32())}
    for name, values in arrays.items():
        # the values' first bytes, then their second ones, and so on: ids and places hardly differ in the high ones, which then compress
        each = values[order].view(np.uint8).reshape(len(values), -1)
        out[name] = pa.array([each[cuts[b] : cuts[b + 1]].tobytes("F") for b in used], pa.binary())
    return pa.RecordBatch.from_pydict(out)


def unpacked(cells: list[bytes], kind: str) -> np.ndarray:
    """The values of several cells that `packed` made."""
    width = np.dtype(kind).itemsize
    sizes = [len(c) // width for c in cells]
    out, at = np.empty((sum(sizes), width), np.uint8), 0
    for cell, n in zip(cells, sizes, strict=True):
        out[at : at + n] = np.frombuffer(cell, np.uint8).reshape(width, n).T
        at += n
    return out.view(kind).reshape(-1)


def schema(columns: list[str]) -> str:
    return ", ".join(["bucket int", "lo binary", "hi binary", *[f"{c} binary" for c in columns]])


def met(batches, columns: dict[str, str]) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """All that has come to a task: the hashes (48 bits) and the columns."""
    kinds = {"lo": "<u4", "hi": "<u2", **columns}
    parts: dict[str, list[bytes]] = {k: [] for k in kinds}
    for b in batches:
        for k in kinds:
            parts[k] += b.column(b.schema.get_field_index(k)).to_pylist()
    arrays = {k: unpacked(parts[k], kind) for k, kind in kinds.items()}
    hashes = arrays.pop("lo").astype(np.uint64) | arrays.pop("hi").astype(np.uint64) << np.uint64(32)
    return (hashes, arrays) if len(hashes) else None


def dealt(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket")


def starts_of(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_values[1:] != sorted_values[:-1]) + 1, [len(sorted_values)]])


def sought(docs: DataFrame, ids: DataFrame, id_col: str, bound: int = 500_000) -> DataFrame:
    """The rows of docs whose id is in ids (one column, distinct): by a broadcast of at most `bound` ids, or by a shuffle beyond."""
    few = ids.limit(bound + 1).count() <= bound
    return docs.join(F.broadcast(ids) if few else ids, id_col, "left_semi")
