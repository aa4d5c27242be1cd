"""Helpers the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A-Z to a-z, every other byte as it is.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLICE_BYTES = 8 << 20


def kept_columns(df: DataFrame, keep: Sequence[str] | None, new: Sequence[str]) -> list[str]:
    """Columns carried through: `keep` or all; one that has the name of a result column gives way to it."""
    return [c for c in (df.columns if keep is None else keep) if c not in new]


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict], fields: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """`fields` (DDL) computed by `fn` from lists of texts (null: empty), beside the kept columns. `fn` gets slices of bounded size, so a batch
    of very long texts does not have to fit in memory twice; it never sees more than one row group of one partition."""
    added = T.StructType.fromDDL(fields)
    carried = kept_columns(df, keep, added.names)
    source = df.select(*[F.col(f"`{c}`") for c in carried], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            sizes = np.cumsum(batch.column(batch.num_columns - 1).nbytes / batch.num_rows * np.ones(batch.num_rows))
            rows = max(1, int(np.searchsorted(sizes, SLICE_BYTES)))
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                got = fn(part.column(part.num_columns - 1).to_pylist())
                arrays = [*part.columns[:-1], *(got[n] if isinstance(got[n], pa.Array) else pa.array(got[n]) for n in added.names)]
                yield pa.RecordBatch.from_arrays(arrays, [*carried, *added.names])

    return source.mapInArrow(run, schema)


def scaled_partitions(df: DataFrame, at_least: int = 0) -> int:
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; works in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit keyed hash of each word, the same on every machine."""
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False)


def word_shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of `width` words; fewer words: one shingle of all of them; none: empty. A-Z count as a-z; words are
    parted by blanks, tabs and line ends."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = max(1, len(h) - width + 1)
    odd = np.random.default_rng(7 + min(width, len(h))).integers(1, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out += h[k:k + n] * odd[k]
    return np.unique(mix(out))


def interval(cuts: list[tuple[int, int]]):
    """Column function (key, tie) -> number of cuts at or before it. `cuts` are sorted pairs; looked up by binary search in Arrow batches, as nested
    conditions over hundreds of cuts outgrow what can be compiled."""
    keys, ties = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        shared = np.flatnonzero(lo < hi)
        out = hi.astype(np.int32)
        for v in np.unique(k[shared]):  # at most one round per cut
            at = shared[k[shared] == v]
            a, b = lo[at[0]], hi[at[0]]
            out[at] = a + np.searchsorted(ties[a:b], t[at], "right")
        return pd.Series(out)

    return place
