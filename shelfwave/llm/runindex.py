"""Repeated passages by a run-length index: bytes that are covered by a string of `length` bytes which also starts in a document of a smaller key.

Every such string has an anchor, the least hash of its k-grams, and equal strings have the same one. Strings whose anchor is in one document alone
cannot repeat; of the others the stretches around the anchor meet by anchor. There a run-compressed Burrows-Wheeler transform over the strings, with
samples at the ends of its runs, is walked by all stretches at once and tells of each string the least document that has it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwave.llm.common import kept_columns, mix
from shelfwave.llm.sharing import MOST_FREQUENT, frequent_codes, shared_codes, slices
from shelfwave.session import cut_lineage

LENGTH, GRAM = 50, 20  # bytes of a string, bytes of an anchor
BLOCK = 1 << 20  # bytes of a text hashed at once
SLICE = 4 << 20  # bytes of texts cut at once
STRETCH = 64  # strings of one stretch at most
CHUNK = 1 << 20  # bytes of stretches indexed together, and the group of the last anchor
HOT = 50_000  # rows with one anchor, up to which its stretches (some 7 MB) meet in one task
PARTS = 8  # parts of the anchors for each shuffle partition
PARCEL = 8 << 20  # bytes of stretches packed together
PARCELS = 2  # groups of anchors for each shuffle partition, whose stretches are packed together


def gram_hashes(raw: bytes, size: int) -> np.ndarray:
    """Hash of each run of `size` bytes, put together from runs of powers of two."""
    h = mix(np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    n, step, at, out = len(h) - size + 1, 1, 0, None
    while step <= size:
        if size & step:
            out = h[at:at + n].copy() if out is None else out * np.uint64(0xC4CEB9FE1A85EC53) + h[at:at + n]
            at += step
        if 2 * step <= size:
            h = h[:-step] * np.uint64(0x9E6C63D0876A9A35) + h[step:]
            h ^= h >> np.uint64(31)
        step *= 2
    return mix(out)


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings that follow each other and have the same anchor, STRETCH strings at most: hash, first start, number of starts."""
    found: list[tuple] = []
    for begin in range(0, len(raw) - length + 1, BLOCK):
        h = gram_hashes(raw[begin:begin + BLOCK + length - 1], gram)
        n, window, step = len(h) - (length - gram), length - gram + 1, 1
        while 2 * step <= window:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        least = np.minimum(h[:n], h[window - step:window - step + n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        many = np.diff(np.append(first, n))
        if many.max(initial=0) > STRETCH:  # periodic text
            pieces = -(-many // STRETCH)
            within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            ends = np.repeat(first + many, pieces)
            first = np.repeat(first, pieces) + STRETCH * within
            many = np.minimum(STRETCH, ends - first)
        found.append((least[first], begin + first, many))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _codes(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of an anchor and 32 bits that tell it apart there. Anchors that share both are only looked at together."""
    return (((hashes >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))).view(np.int64)


@dataclass
class RunIndex:
    """Index of all strings of `length` bytes of the given stretches, of which each belongs to an owner.

    Each distinct string is one node; nodes are in order of their bytes. The transform lists, for each prefix of length - 1 bytes in order, the bytes
    that precede it; the n-th occurrence of a byte in it leads to the n-th node that begins with this byte and has a follower. It is kept as runs. A
    run ends where the byte changes or where the least owner does on the way; its first place has the least owner as a sample, all others pass on what
    was known before. Every stretch enters at its last string, whose node is sampled too."""

    prefix: np.ndarray  # of each node its first bytes' number
    entry: np.ndarray  # of each prefix its first place in the transform, and the end
    order: np.ndarray  # runs by byte and place: byte * (places + 1) + place
    place: np.ndarray  # of each of them its first place,
    size: np.ndarray  # its length,
    before: np.ndarray  # the places of smaller bytes, and of this byte before it,
    sample: np.ndarray  # and the least owner of the node its first place leads to
    target: np.ndarray  # nodes that have a follower
    last: np.ndarray  # node of each stretch's last string
    last_owner: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, begin: np.ndarray, many: np.ndarray, owner: np.ndarray, length: int) -> RunIndex:
        """Stretch k is text[begin[k]:begin[k] + many[k] + length - 1]."""
        stretch = np.repeat(np.arange(len(begin)), many)
        inside = np.arange(len(stretch)) - np.repeat(np.cumsum(many) - many, many)
        at = begin[stretch] + inside
        words = -(-length // 8)
        padded = np.concatenate([text, np.zeros(8 * words, np.uint8)])
        eight = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(text) + 8 * (words - 1) + 1,), (1,))
        keys = [eight[at + 8 * k].astype(np.uint64) for k in range(words)]
        cut = length - 8 * (words - 1)
        keys[-1] &= ~np.uint64((1 << (64 - 8 * cut)) - 1) if cut < 8 else np.uint64(2**64 - 1)
        rank = np.lexsort(keys[::-1])
        differs = lambda ks: np.any([k[1:] != k[:-1] for k in ks], axis=0)
        keys = [k[rank] for k in keys]
        new = np.concatenate([[True], differs(keys)])
        keys[-1] &= ~np.uint64(0xFF << (64 - 8 * cut))
        new_prefix = np.concatenate([[True], differs(keys)])
        first = np.flatnonzero(new)
        node = np.empty(len(rank), np.int64)
        node[rank] = np.cumsum(new) - 1
        least = np.minimum.reduceat(owner[stretch][rank], first)
        prefix = (np.cumsum(new_prefix) - 1)[first]
        # a string with one before it in its stretch: (prefix, byte before) names the node that the two share
        led = np.flatnonzero(inside > 0)
        pair, some = np.unique(prefix[node[led]] * 256 + text[at[led] - 1], return_index=True)
        to, byte, of_prefix = node[led[some] - 1], pair % 256, pair // 256
        entry = np.searchsorted(of_prefix, np.arange(prefix[-1] + 2))
        # passed on: every node of the prefix has the least owner of the node before
        low, high = (f.reduceat(least, np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))) for f in (np.minimum, np.maximum))
        passed = (low[of_prefix] == least[to]) & (high[of_prefix] == least[to])
        starts = np.flatnonzero(np.concatenate([[True], (byte[1:] != byte[:-1]) | ~passed[1:]])) if len(byte) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(byte)))
        by = np.lexsort((starts, byte[starts]))
        place, size = starts[by], sizes[by]
        ends = np.cumsum(many) - 1
        return cls(prefix, entry, byte[place] * (len(byte) + 1) + place, place, size, np.cumsum(size) - size, least[to[place]], np.sort(to), node[ends], least[node[ends]])

    def least_owners(self, text: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
        """Least owner of each string of the stretches, in order. All stretches are walked from their last string to their first at once."""
        upto = np.cumsum(many)
        out = np.empty(int(upto[-1]) if len(upto) else 0, np.int64)
        walk, node, known = np.arange(len(begin)), self.last, self.last_owner
        out[upto - 1] = known
        places = int(self.size.sum())
        for step in range(1, int(many.max(initial=0))):
            on = many[walk] > step
            walk, node, known = walk[on], node[on], known[on]
            byte = text[begin[walk] + many[walk] - 1 - step].astype(np.int64)
            after = self.entry[self.prefix[node] + 1]  # the end of the prefix's places; the byte is among them once
            run = np.searchsorted(self.order, byte * (places + 1) + after, "left") - 1
            within = np.minimum(after - self.place[run], self.size[run]) - 1
            node = self.target[self.before[run] + within]
            known = np.where(within == 0, self.sample[run], known)
            out[upto[walk] - 1 - step] = known
        return out


def _spans(begin: np.ndarray, many: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of starts whose place in `off` (all stretches' strings in order) is set: stretch of each run, and first * 2^32 + last + 1."""
    base = np.cumsum(many) - many
    edge = np.zeros(len(off) + 1, bool)
    edge[base] = edge[-1] = True
    first = np.flatnonzero(off & (edge[:-1] | ~np.concatenate([[False], off[:-1]])))
    last = np.flatnonzero(off & (edge[1:] | ~np.concatenate([off[1:], [False]])))
    of = np.searchsorted(base, first, "right") - 1
    shift = begin[of] - base[of]
    return of, ((first + shift) << 32) | (last + 1 + shift)


def marked(raw: list[bytes], code: np.ndarray, key: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows (stretch, anchor, document, start) that hold all rows of their anchors: row and span of each run of strings that a smaller document has."""
    place: dict[tuple, int] = {}
    at = np.array([place.setdefault(x, len(place)) for x in zip(code.tolist(), raw, strict=True)])
    owner = np.full(len(place), np.iinfo(np.int64).max)
    np.minimum.at(owner, at, key)
    group = np.array([c for c, _ in place])
    many = np.array([len(b) for _, b in place]) - (length - 1)
    upto = np.cumsum(many)
    least = np.repeat(owner, many)
    # an anchor with one stretch has nothing to index: its strings are nowhere else
    _, which, sizes = np.unique(group, return_inverse=True, return_counts=True)
    several = sizes[which] > 1
    if several.any():
        text = np.frombuffer(b"".join([b for (_, b), s in zip(place, several.tolist(), strict=True) if s]), np.uint8)
        some = many[several]
        begin = np.cumsum(some + length - 1) - (some + length - 1)
        least[np.repeat(several, many)] = RunIndex.of(text, begin, some, owner[several], length).least_owners(text, begin, some)
    own = many[at]
    here = np.repeat(upto[at] - np.cumsum(own), own) + np.arange(own.sum())
    return _spans(start, own, least[here] < np.repeat(key, own))


def parcels(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    """Rows (stretch's anchor, bytes, document, rid, start) packed by group of anchors, some PARCEL bytes of stretches at a time: equal stretches once,
    all compressed together, as they are most of what is moved."""
    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        code, key, rid, start = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in (0, 2, 3, 4))
        # equal bytes have one anchor
        coded = pa.chunked_array([b.column(1) for b in held]).combine_chunks().dictionary_encode()
        which, group = coded.indices.to_numpy(), (code >> 32) % groups
        order = np.lexsort((start, rid, key, group))
        bounds = np.searchsorted(group[order], np.arange(groups + 1))
        out: list[tuple[int, int, bytes]] = []
        for g in np.flatnonzero(np.diff(bounds)).tolist():
            rows = order[bounds[g]:bounds[g + 1]]
            some, first, at = np.unique(which[rows], return_index=True, return_inverse=True)
            each = coded.dictionary.take(pa.array(some)).to_pylist()
            ids, doc = np.unique(np.stack([key[rows], rid[rows]], axis=1), axis=0, return_inverse=True)
            numbers = [np.array([len(some), len(rows), len(ids)]), code[rows][first], np.array([len(b) for b in each], "<u4"), at.astype("<u4"), doc.ravel().astype("<u4"), start[rows].astype("<u4"), ids]
            plain = b"".join([*(v.tobytes() for v in numbers), *each])
            out.append((g, len(plain), pa.compress(plain, "zstd", asbytes=True)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "size", "packed"])

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(1).nbytes
        if size > PARCEL:
            yield packed(held)
            held, size = [], 0
    if held:
        yield packed(held)


def unpacked(packed: list[tuple[int, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a group's parcels: all bytes; of each stretch its place there and size; of each row its stretch; anchor, document, rid, start."""
    raw, places, ats, rows, base, stretches = [], [], [], [], 0, 0
    for size, blob in packed:
        plain, at = pa.decompress(blob, size, "zstd", asbytes=True), 0

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            at += np.dtype(kind).itemsize * n
            return np.frombuffer(plain, kind, n, at - np.dtype(kind).itemsize * n)  # noqa: B023

        some, many, docs = take("<i8", 3).tolist()
        code, sizes = take("<i8", some), take("<u4", some).astype(np.int64)
        of, doc, start = take("<u4", many).astype(np.int64), take("<u4", many), take("<u4", many).astype(np.int64)
        ids = take("<i8", 2 * docs).reshape(-1, 2)[doc]
        places.append(np.stack([base + np.cumsum(sizes) - sizes, sizes]))
        ats.append(stretches + of)
        rows.append(np.stack([code[of], ids[:, 0], ids[:, 1], start]))
        raw.append(plain[at:])
        base, stretches = base + len(raw[-1]), stretches + some
    place, sizes = np.concatenate(places, axis=1)
    return b"".join(raw), place, sizes, np.concatenate(ats), np.concatenate(rows, axis=1)


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, with_text: bool = False, most_hot: int = MOST_FREQUENT) -> DataFrame:
    """The kept columns, n_bytes, n_removed, n_spans and kept_sha256 of every row, where a byte is removed if a string of `length` bytes over it also starts
    in a row of a smaller key; `with_text` adds the rest of the text as `kept` (binary: a cut may part a character).

    Strings are judged on the input: overlaps count, and what a smaller row loses still counts. Matches do not cross rows. Texts are UTF-8; null is
    empty. Rows of one key do not remove from each other, repeated rows included. A null key is neither smaller nor larger than any: such a row stays
    whole and removes nothing. Result columns replace input columns of the same name; others do not matter. An empty table gives an empty result.

    Copies of a whole text need no index: all but those of the least key lose everything. Stretches of an anchor in over HOT rows do not meet in one
    task: equal ones are put together first, and what differs meets string by string."""
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    carried = kept_columns(docs, keep, results)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], F.col(f"`{key}`").cast("long").alias("key"), whole.alias("text"), F.xxhash64(whole).alias("rid"), F.xxhash64(F.lit(1), whole).alias("rid2"))
    long_ = source.where((F.octet_length("text") >= length) & F.col("key").isNotNull())
    anchored = lambda t: np.unique(_codes(anchors(t.encode(), length)[0], parts))
    found = shared_codes(long_.select("key", "rid", F.col("text").alias("value")), anchored, parts, HOT, narrow=True)
    hot = spark.sparkContext.broadcast(frequent_codes(found, most_hot))
    heads = long_.groupBy("rid", "rid2").agg(F.min("key").alias("least"))
    named = cut_lineage(long_.select("key", "rid", "rid2").distinct().join(heads, ["rid", "rid2"]).select("key", "rid", (F.col("key") > F.col("least")).alias("copy")))
    wanted = (found.where("found is not null").groupBy("key", "rid").agg(F.collect_set("found").alias("found")).join(named.where("not copy").select("key", "rid"), ["key", "rid"]))

    def stretches(often: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            frequent, last = hot.value, None
            for batch in slices(batches, batch_text, SLICE):
                out: tuple[list, ...] = ([], [], [], [], [])
                for k, r, t, f in zip(*(batch.column(c).to_pylist() for c in (batch_text - 2, batch_text - 1, batch_text, batch_text + 1)), strict=True):
                    if f is None or (k, r) == last:  # nothing shared, or a repeated row
                        continue
                    last = k, r
                    codes = np.concatenate([np.frombuffer(b, "<i8") for b in f])
                    codes = codes[np.isin(codes, frequent) == often]
                    if not len(codes):
                        continue
                    raw = t.encode()
                    h, first, many = anchors(raw, length)
                    code = _codes(h, parts)
                    here = np.isin(code, codes)
                    first = first[here]
                    for into, v in zip(out, (code[here].tolist(), [raw[a:b] for a, b in zip(first.tolist(), (first + many[here] + length - 1).tolist(), strict=True)],
                                             [k] * len(first), [r] * len(first), first.tolist()), strict=True):
                        into += v
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, stretch_schema, strict=True)], schema=stretch_schema)

        return run

    stretch_fields = "code bigint, bytes binary, key bigint, rid bigint, start bigint"
    stretch_schema = to_arrow_schema(T.StructType.fromDDL(stretch_fields))
    # all joins to the texts are alike, so Spark moves the texts once and reads them again
    names, batch_text = [*(f"c{k}" for k in range(len(carried))), "key", "rid", "text"], len(carried) + 2
    met = lambda make, fields: source.join(wanted, ["key", "rid"], "left").select(*names, "found").mapInArrow(make, fields)

    def judged(packed: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        raw, place, size, at, rows = unpacked(packed)
        order = np.argsort(rows[0], kind="stable")
        at, rows = at[order], rows[:, order]
        upto, begin = np.cumsum(size[at]), 0
        while begin < len(at):  # some CHUNK bytes, and all rows of the last anchor
            last = min(len(at) - 1, int(np.searchsorted(upto, CHUNK + (upto[begin - 1] if begin else 0))))
            end = int(np.searchsorted(rows[0], rows[0][last], "right"))
            some = at[begin:end]
            code, key, rid, start = rows[:, begin:end]
            row, span = marked([raw[a:a + n] for a, n in zip(place[some].tolist(), size[some].tolist(), strict=True)], code, key, start, length)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(rid[row]), pa.array(span)], ["key", "rid", "span"])
            begin = end

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:  # sorted by part
            for part, *parcel in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and held:
                    yield from judged(held)
                    held = []
                last = part
                held.append(parcel)
        if held:
            yield from judged(held)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = met(lambda batches: parcels(stretches(False)(batches), PARCELS * tasks), "part int, size bigint, packed binary")
    plain = sent.repartitionById(tasks, F.expr(f"part % {tasks}")).sortWithinPartitions("part")
    spans = plain.mapInArrow(indexed, "key bigint, rid bigint, span bigint")
    if len(hot.value):
        spans = spans.unionByName(_hot_spans(cut_lineage(met(stretches(True), stretch_fields)), length))
    taken = named.join(spans.groupBy("key", "rid").agg(F.collect_list("span").alias("spans")), ["key", "rid"], "left")
    fields = [("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string"), *([("kept", "binary")] if with_text else [])]
    schema = T.StructType([*source.schema.fields[:len(carried)], *T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in fields))])
    result = to_arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_text, SLICE):
            out: list[tuple] = []
            for t, copy, found_ in zip(*(batch.column(batch_text + k).to_pylist() for k in range(3)), strict=True):
                raw, spans_ = t.encode(), np.zeros((0, 2), np.int64)
                if copy:
                    spans_ = np.array([[0, len(raw)]])
                elif found_:
                    each = np.sort(np.array(found_, np.int64))
                    each = np.stack([each >> 32, (each & 0xFFFFFFFF) + length - 1], axis=1)
                    reach = np.maximum.accumulate(each[:, 1])
                    new = np.concatenate([[True], each[1:, 0] > reach[:-1]])
                    spans_ = np.stack([each[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(each) - 1)]], axis=1)
                rest = b"".join(raw[a:b] for a, b in zip([0, *spans_[:, 1].tolist()], [*spans_[:, 0].tolist(), len(raw)], strict=True))
                out.append((len(raw), len(raw) - len(rest), len(spans_), hashlib.sha256(rest).hexdigest(), *([rest] if with_text else [])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(carried)], *(pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), list(result)[len(carried):], strict=True))], schema=result)

    full = source.join(taken, ["key", "rid"], "left").select(*names, "copy", "spans")
    return full.mapInArrow(cut, schema).toDF(*carried, *results)


def _hot_spans(met: DataFrame, length: int) -> DataFrame:
    """(key, rid, span) of stretches whose anchor is in very many rows. Equal stretches are one from the first aggregate on, then the strings of the
    different ones meet by 128 bits of a hash; the way back is by joins, whose frequent keys adaptive execution splits."""
    named = met.select("key", "rid", "start", "bytes", F.xxhash64("bytes").alias("s1"), F.xxhash64(F.lit(1), "bytes").alias("s2"))
    distinct = named.groupBy("s1", "s2").agg(F.min("key").alias("owner"), F.min("bytes").alias("bytes"))
    each = distinct.select("s1", "s2", "owner", F.posexplode(F.expr(f"transform(sequence(1, length(bytes) - {length - 1}), k -> substring(bytes, k, {length}))")).alias("k", "string"))
    each = each.select("s1", "s2", "owner", "k", F.xxhash64("string").alias("w1"), F.xxhash64(F.lit(1), "string").alias("w2"))
    least = each.groupBy("w1", "w2").agg(F.min("owner").alias("least"))
    off = each.join(least, ["w1", "w2"]).where("least < owner").groupBy("s1", "s2").agg(F.collect_list("k").alias("off"))  # STRETCH at most
    judged = distinct.select("s1", "s2", "owner", (F.length("bytes") - (length - 1)).alias("many")).join(off, ["s1", "s2"], "left")

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, rid, start, owner, many = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            place = np.cumsum(many) - many
            flags = np.repeat(key > owner, many)
            for p, off_ in zip(place.tolist(), batch.column(5).to_pylist(), strict=True):
                if off_:
                    flags[p + np.array(off_)] = True
            row, span = _spans(start, many.astype(np.int64), flags)
            yield pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array(rid[row]), pa.array(span)], ["key", "rid", "span"])

    return named.drop("bytes").join(judged, ["s1", "s2"]).select("key", "rid", "start", "owner", "many", "off").mapInArrow(marks, "key bigint, rid bigint, span bigint")
