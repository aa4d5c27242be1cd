"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range is retained.

Sketches of one scale merge by union, and the retained part of any set is a uniform sample of it, so containment can be estimated between documents
of very unequal length."""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwave.llm.common import interval, map_texts, mix

WIDTH, SCALE, BYTES = 16, 16, 6  # code points of a shingle (a power of two); one hash in SCALE is retained; bytes of a retained hash


def shingle_hashes(text: str) -> np.ndarray:
    """Hashes of all windows of WIDTH code points, by doubling; a shorter text is one shingle, an empty one has none."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(h) == 0:
        return h
    if len(h) < WIDTH:
        h = np.concatenate([h + np.uint64(1), np.zeros(WIDTH - len(h), np.uint64)])
    h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    step = 1
    while step < WIDTH:
        h = h[:-step] * np.uint64(0x9E6C63D0876A9A35) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    return mix(h)


def sketch(text: str) -> np.ndarray:
    """Sorted retained hashes, shortened to BYTES bytes."""
    h = shingle_hashes(text)
    kept = h[h < np.uint64(2**64 // SCALE)]
    return np.unique(kept >> np.uint64(60 - 8 * BYTES)) if len(kept) else kept


def fingerprint(text: str, values: np.ndarray | None = None) -> str:
    """A tag of the whole text, so equal texts are known even where nothing is retained, then the retained hashes in base64."""
    values = sketch(text) if values is None else values
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES].tobytes()
    return hashlib.blake2b(text.encode(), digest_size=BYTES).hexdigest() + base64.b64encode(raw).decode()


def values_of(print_: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(print_[2 * BYTES:]), np.uint8).reshape(-1, BYTES)
    return np.pad(raw, ((0, 0), (0, 8 - BYTES))).copy().view("<u8").ravel()


def merged(*prints: np.ndarray) -> np.ndarray:
    """The sketch of several documents together."""
    return np.unique(np.concatenate(prints))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 0 where a retained none."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray, same: bool = False) -> float:
    """Estimated resemblance, 0 to 1. `same` (equal tags): 1. Nothing retained on either side: 0."""
    if same:
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text: str = "text", keep=None) -> DataFrame:
    """Adds `fingerprint` to every row, in one pass without a shuffle. Null or empty text: the tag of the empty text alone."""
    return map_texts(docs, lambda texts: {"fingerprint": list(map(fingerprint, texts))}, "fingerprint string", text, keep)


def _cuts(rows: DataFrame, bins: int) -> list[tuple[int, int]]:
    """Places (__order, __tie) that part the rows into about `bins` bins."""
    if bins < 2:
        return []
    keys = Counter(int(q) for q in rows.approxQuantile("__order", [k / bins for k in range(1, bins)], 1 / (4 * bins)))
    cuts = {(k + 1, 0) for k in keys}
    often = [k for k, n in keys.items() if n > 1]
    if often:  # at most bins / 2 keys
        shares = F.array(*[F.lit(j / bins) for j in range(1, bins)])
        for r in rows.where(F.col("__order").isin(often)).groupBy("__order").agg(F.percentile_approx("__tie", shares, F.lit(4 * bins)).alias("ties")).collect():
            cuts |= {(r["__order"], 0), *((r["__order"], t + 1) for t in r["ties"][::max(1, bins // keys[r["__order"]])])}
    return sorted(cuts)


def with_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", bins: int | None = None) -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, where the edited text has its last half
    replaced by the start of the next row's text by (key, text), nulls first; after the last row comes the first.

    Rows go once to bins of keys. The first row of each bin is sent to the bin before as well, so each bin knows the row after its last one, and
    nothing larger than a key per bin passes the driver. Bins are cut at approximate quantiles of the keys; a key that would fill several bins (null keys
    included) is cut again at quantiles of its texts' first bytes, which are in text order. Rows under one key whose texts begin alike share a bin. Repeated
    rows keep a row each; null keys come first; an empty table gives an empty result."""
    n = bins or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{key}`"), F.lit(-(2**63))).alias("__order"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    rows = rows.withColumn("__tie", F.conv(F.rpad(F.hex(F.substring(F.col("__text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"))
    dealt = rows.withColumn("__bin", interval(_cuts(rows, n))(F.col("__order"), F.col("__tie")))
    least = dealt.groupBy("__bin").agg(F.min(F.struct("__order", "__tie")).alias("least")).select("__bin", "least.*").orderBy("__bin").collect()  # three numbers per bin
    # the last bin comes before the first
    before = docs.sparkSession.createDataFrame([(r["__bin"], r["__order"], r["__tie"], least[k - 1]["__bin"]) for k, r in enumerate(least)], "__bin int, least bigint, least_tie bigint, earlier int")
    firsts = (dealt.where(F.col("__order").isin([r["__order"] for r in least])).join(F.broadcast(before), "__bin").where("__order = least and __tie = least_tie")
              .groupBy("earlier", "__order").agg(F.min("__text").alias("__text")))
    back = firsts.select(F.lit(None).cast(docs.schema[key].dataType).alias("__key"), "__order", "__text", F.col("earlier").alias("__bin"), F.lit(True).alias("__guest"))
    both = dealt.select("__key", "__order", "__text", "__bin", F.lit(False).alias("__guest")).unionByName(back)
    ordered = both.repartition(n, "__bin").sortWithinPartitions("__bin", "__guest", "__order", "__text").select("__key", "__text", "__guest")
    fields = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose successor has not come yet: key, text, sketch, fingerprint
        for batch in batches:
            out: list[tuple] = []
            for k, t, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                values = sketch(t)
                mark = fingerprint(t, values)
                if held is not None:
                    hk, ht, hv, hm = held
                    half = len(ht) // 2
                    edited = ht[:len(ht) - half] + t[:half]
                    ev = sketch(edited)
                    em = fingerprint(edited, ev)
                    out.append((hk, len(ht), hashlib.sha256(edited.encode()).hexdigest(), hm, em, likeness(hv, ev, hm == em), likeness(hv, values, hm == mark)))
                held = None if guest else (k, t, values, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], arrow.names)

    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(run, schema)
