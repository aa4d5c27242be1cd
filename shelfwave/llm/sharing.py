"""Which of the codes (64-bit hashes) of a row other rows have too, without moving rows to frequent codes."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.clientserver import DEFAULT_WORKER_SLEEP_TIME
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwave.session import cut_lineage

SLICE = 4 << 20  # bytes of values whose codes are sent together
ROWS = 1 << 16  # rows of a slice at most: their numbers go as 16 bits
MOST_FREQUENT = 1 << 20  # codes every task may be told: 8 MB


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about `most` bytes in a string or binary column, and at most `rows` rows."""
    for batch in batches:
        upto, start = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while start < batch.num_rows:
            end = min(start + rows, max(start + 1, int(np.searchsorted(upto, most + (upto[start - 1] if start else 0), "right"))))
            yield batch.slice(start, end - start)
            start = end


def shared_codes(rows: DataFrame, codes: Callable[[object], np.ndarray], parts: int, frequent: int, narrow: bool = False) -> DataFrame:
    """rows (key, rid, value) -> (key, rid, found): of each row its codes that other rows have too, as bytes, in one or more rows; and (code, rows) of the
    codes of over `frequent` rows. `codes` gives the distinct codes of a value; their upper 32 bits modulo `parts` are their part. `narrow`: the upper 32
    bits are the part, so only the others are sent.

    Codes that several rows of a slice share are known to be shared at once: they travel as one number with a count, and their rows pass by. All others
    go to their part with their row, so no task gets the rows of a frequent code."""
    kind = "<u4" if narrow else "<i8"
    fields = "part int, own binary, row binary, ids binary, known binary, times binary, key bigint, rid bigint, found binary"
    arrow = to_arrow_schema(T.StructType.fromDDL(fields))
    names = ["key", "rid", "found", "code", "rows"]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, SLICE, ROWS):
            keys, rids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            own = [codes(v.as_py()) for v in batch.column(2)]
            row, code = np.repeat(np.arange(len(own)), list(map(len, own))), np.concatenate(own)
            part = (code >> 32) % parts
            order = np.lexsort((code, part))
            row, code, part = row[order], code[order], part[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
            times = np.diff(np.append(first, len(code)))
            several = np.repeat(times > 1, times)
            many = first[times > 1]
            lone_code, lone_row, lone_part = code[~several], row[~several], part[~several]
            out: list[tuple] = []
            for p in np.unique(part).tolist():
                a, b = np.searchsorted(lone_part, (p, p + 1))
                c, d = np.searchsorted(part[many], (p, p + 1))
                used, at = np.unique(lone_row[a:b], return_inverse=True)
                out.append((p, lone_code[a:b].astype(kind).tobytes(), at.astype("<u2").tobytes(), np.stack([keys[used], rids[used]], axis=1).astype("<i8").tobytes(),
                            code[many[c:d]].astype(kind).tobytes(), times[times > 1][c:d].astype("<u4").tobytes(), None, None, None))
            by = np.argsort(row[several], kind="stable")
            past_row, past_code = row[several][by], code[several][by]
            for r in np.unique(past_row).tolist():
                a, b = np.searchsorted(past_row, (r, r + 1))
                out.append((int(rids[r] + r) % parts, None, None, None, None, None, int(keys[r]), int(rids[r]), past_code[a:b].astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def judged(part: int, own: list, row: list, ids: list, known: list, times: list) -> pa.RecordBatch:
        base = np.cumsum([0, *map(len, ids)])
        at = np.concatenate([r.astype(np.int64) + b for r, b in zip(row, base, strict=False)])
        lone, told = np.concatenate(own), np.concatenate(known)
        code, n = np.unique(np.concatenate([lone, told]), return_counts=True)
        place = np.searchsorted(code, told)
        n -= np.bincount(place, minlength=len(code))
        np.add.at(n, place, np.concatenate(times))
        keep = n[np.searchsorted(code, lone)] > 1
        upper = part << 32 if narrow else 0
        named = np.concatenate(ids)[at[keep]]
        order = np.lexsort((lone[keep], named[:, 1], named[:, 0]))
        named, full = named[order], lone[keep][order].astype(np.int64) + upper
        cut = np.flatnonzero(np.any(named[1:] != named[:-1], axis=1)) + 1 if len(named) else np.zeros(0, np.int64)
        some = named[np.concatenate([[0], cut])] if len(named) else named
        found = [x.astype("<i8").tobytes() for x in np.split(full, cut)] if len(named) else []
        often = n > frequent
        m, k = len(found), int(often.sum())
        return pa.RecordBatch.from_arrays([pa.array([*some[:, 0].tolist(), *[None] * k], pa.int64()), pa.array([*some[:, 1].tolist(), *[None] * k], pa.int64()), pa.array([*found, *[None] * k], pa.binary()),
                                           pa.array([*[None] * m, *(code[often].astype(np.int64) + upper).tolist()], pa.int64()), pa.array([*[None] * m, *n[often].tolist()], pa.int64())], names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [], [], [])
        for batch in batches:  # sorted by part
            past = batch.filter(pa.array(batch.column(8).is_valid()))
            if past.num_rows:
                yield pa.RecordBatch.from_arrays([*past.columns[6:9], pa.nulls(past.num_rows, pa.int64()), pa.nulls(past.num_rows, pa.int64())], names)
            rest = batch.filter(pa.array(batch.column(8).is_null()))
            for part, *blobs in zip(*(c.to_pylist() for c in rest.columns[:6]), strict=True):
                if part != last and held[0]:
                    yield judged(last, *held)
                    held = ([], [], [], [], [])
                last = part
                for into, b, k in zip(held, blobs, (kind, "<u2", "<i8", kind, "<u4"), strict=True):
                    values = np.frombuffer(b, k)
                    into.append(values.reshape(-1, 2) if into is held[2] else values)
        if held[0]:
            yield judged(last, *held)

    found = cut_lineage(rows.select("key", "rid", "value").mapInArrow(send, fields).repartition("part").sortWithinPartitions("part").mapInArrow(gather, "key bigint, rid bigint, found binary, code bigint, rows bigint"))
    # what was moved for it is of no more use; Spark removes its files when the driver collects its garbage, so it is told to. Before that, Python has to let
    # go of the frames (they lie in cycles), of which its gateway tells the JVM within a second
    gc.collect()
    time.sleep(2 * DEFAULT_WORKER_SLEEP_TIME)
    rows.sparkSession.sparkContext._jvm.System.gc()
    return found


def frequent_codes(found: DataFrame, most: int = MOST_FREQUENT) -> np.ndarray:
    """Codes of most rows, at most `most`: all that shared_codes told, or those above the least power of two times its bound that leaves few enough."""
    often, bound = found.where("code is not null").select("code", "rows"), 1
    while often.where(F.col("rows") > bound).count() > most:
        bound *= 2
    return np.sort(often.where(F.col("rows") > bound).toArrow().column("code").to_numpy())
