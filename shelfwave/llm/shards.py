"""Histogram sort: shards of near-equal bytes, cut at key boundaries found by counting, filled by one exchange."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwave.session import cut_lineage

OVERHEAD = 16  # bytes a row takes beside its text
TIE_BITS, ROW_BITS = 60, 63  # a place in the order is (key, tie, row), held in the driver as one number with these bits below the key
BELOW = TIE_BITS + ROW_BITS
_LOWEST = -(2**63)


def _interval(cuts: list[int]) -> Column:
    """Number of cuts at or below a row's place. Cuts are looked up by key and tie; only rows at the very place of a cut are looked up by their row too."""
    pairs = [((c >> BELOW), (c >> ROW_BITS) & ((1 << TIE_BITS) - 1)) for c in cuts]
    rows = np.array([c & ((1 << ROW_BITS) - 1) for c in cuts], np.int64)
    first, many = np.unique(np.array(pairs, np.int64).reshape(-1, 2), axis=0, return_counts=True)
    keys, ties, before = first[:, 0], first[:, 1], np.concatenate([[0], np.cumsum(many)])

    @F.pandas_udf("int")
    def place(key: pd.Series, tie: pd.Series, row: pd.Series) -> pd.Series:
        k, t, r = (c.to_numpy(np.int64) for c in (key, tie, row))
        at = np.searchsorted(keys, k, "left")
        shared = np.flatnonzero(at < np.searchsorted(keys, k, "right"))
        for v in np.unique(k[shared]):  # at most one round per cut
            own = shared[k[shared] == v]
            a, b = np.searchsorted(keys, v, "left"), np.searchsorted(keys, v, "right")
            at[own] = a + np.searchsorted(ties[a:b], t[own], "left")
        out = before[at].astype(np.int32)
        on = np.flatnonzero(at < len(keys))
        on = on[(keys[at[on]] == k[on]) & (ties[at[on]] == t[on])]
        for v in np.unique(at[on]):
            own = on[at[on] == v]
            out[own] = before[v] + np.searchsorted(rows[before[v]:before[v + 1]], r[own], "right")
        return pd.Series(out)

    return place(F.col("__key"), F.col("__tie"), F.col("__row"))


def splitters(sizes: DataFrame, shards: int, tolerance: float, probes: int, most_rounds: int = 120) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Places at which shards 1, 2, ... begin, and for every probed place the exact (bytes, rows) before it.

    sizes: (__key, __tie, __row, __size). The first round probes evenly, every later one between the bounds of each splitter that has not settled; each is
    one aggregate with a row per interval. A splitter settles when its error is within `tolerance` of a shard or no place lies between its bounds;
    every round divides the bounds by probes + 1."""
    all_ = sizes.agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows"), F.min("__key").alias("lo"), F.max("__key").alias("hi")).first()
    if not all_["rows"]:
        return [], {}
    low, high, total = all_["lo"] << BELOW, (all_["hi"] + 1) << BELOW, all_["bytes"]
    known = {low: (0, 0), high: (total, all_["rows"])}
    open_ = {k: (low, high) for k in range(1, shards)}
    starts: dict[int, int] = {}
    slack, even = tolerance * total / shards, shards * probes
    asked = {low + (high - low) * k // even for k in range(1, even)}
    for _ in range(most_rounds):
        cuts = sorted(asked - known.keys())
        if cuts:
            found = {r["i"]: (r["bytes"], r["rows"]) for r in sizes.groupBy(_interval(cuts).alias("i")).agg(F.sum("__size").alias("bytes"), F.count("*").alias("rows")).collect()}
            before = (0, 0)
            for k, cut in enumerate(cuts):
                b, n = found.get(k, (0, 0))
                known[cut] = before = (before[0] + b, before[1] + n)
        places = sorted(known)
        sums = [known[p][0] for p in places]
        for k in list(open_):
            target = total * k // shards
            at = min(bisect.bisect_right(sums, target), len(places) - 1)
            lo, hi = places[at - 1], places[at]
            best = lo if target - known[lo][0] <= known[hi][0] - target else hi
            if abs(known[best][0] - target) <= slack or hi - lo <= 1:
                starts[k] = best
                del open_[k]
            else:
                open_[k] = (lo, hi)
        if not open_:
            return [starts[k] for k in range(1, shards)], known
        asked = {lo + (hi - lo) * k // (probes + 1) for lo, hi in open_.values() for k in range(1, probes + 1)}
    raise ValueError(f"splitters did not settle in {most_rounds} rounds")


def sharded(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", tolerance: float = 0.001, probes: int = 15) -> DataFrame:
    """All columns with size, shard and slot. Law "bytes": shards hold near-equal bytes (UTF-8 of the text plus 16; null text: none), within
    `tolerance` of a shard and one row; rows go up by (integer key, hash of the whole row) from shard to shard, and slots number the rows of a shard
    in that order, from 0 without gaps.

    Places and sizes are written once and the splitters found on them; whole rows are exchanged once, by interval of the final histogram, so
    neither a shard nor its numbering needs one task. Null keys come first. Rows under one frequent key part at their hashes, and rows equal in every
    column at their place in the input, which must be repeatable (a table): copies may change places, their numbers and sizes stay. Input columns named
    size, shard or slot are replaced. An empty table gives an empty result."""
    rest = [c for c in docs.columns if c not in ("size", "shard", "slot")]
    size = (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + OVERHEAD).cast("long")
    rows = docs.select(*[F.col(f"`{c}`") for c in rest], size.alias("size"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(_LOWEST)).alias("__key"),
                       F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in rest]), 64 - TIE_BITS).alias("__tie"), F.monotonically_increasing_id().alias("__row"))
    sizes = cut_lineage(rows.select("__key", "__tie", "__row", F.col("size").alias("__size")))
    starts, known = splitters(sizes, shards, tolerance, probes)
    if not known:
        return rows.drop("__key", "__tie", "__row").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    # each interval begins at a place: the shards' own and, between them, as many as keep an interval to a part of a shard
    part, places, last = max(1, max(n for _, n in known.values()) // (shards * probes)), [], -1
    for p in sorted(known)[:-1]:
        if last < 0 or p in starts or known[p][1] - last >= part:
            places.append(p)
            last = known[p][1]
    shard = [bisect.bisect_right(starts, p) for p in places]
    before_shard = [0, *(known[s][1] for s in starts)]
    first = [known[p][1] - before_shard[s] for p, s in zip(places, shard, strict=True)]
    lookup = lambda values, kind: F.element_at(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("__at"))
    number = F.row_number().over(Window.partitionBy("__at").orderBy("__key", "__tie", "__row"))
    return (rows.withColumn("__at", _interval(places)).withColumn("__n", number)
            .select(*[F.col(f"`{c}`") for c in rest], "size", lookup(shard, "int").alias("shard"), (lookup(first, "bigint") + F.col("__n") - 1).alias("slot")))
