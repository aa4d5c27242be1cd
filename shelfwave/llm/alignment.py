"""Alignment of two tokenizers: a byte-level BPE (A) and a sentencepiece model with byte fallback (B) cut the same bytes; where both end a token, a group
ends. All pairs of an A and a B token of one group are links.

Both libraries' own spans give the cuts, as they count whole characters; only where a character is parted among tokens, or falls back to bytes, do the
decoded bytes of the tokens place the cut inside it. Neither tokenizer has a token across a blank that follows a character that is no white space, so
texts are taken apart there and each distinct stretch is aligned once in a worker."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from shelfwave.llm.common import kept_columns, word_hashes
from shelfwave.session import cut_lineage

UNSAFE = re.compile(r"\s ")
BOUNDARY = re.compile(r"(?<=\S)(?= )")
SLICE = 2 << 20  # characters of the texts taken at once
JOINED = 256 << 10  # characters of new stretches that are tokenized in one call
MEMO = 160 << 20  # bytes of aligned stretches a worker remembers, some 1.6 million
PENDING = 2_000_000  # links of documents a task holds before it counts them
FREQUENT = 1 << 20  # pairs whose counts every task gets: 16 bytes each, 16 MB at most; all others are joined
PARTS = 8  # parts of the id pairs for each shuffle partition


class Pair:
    """Both tokenizers, the bytes of their tokens, and what is remembered of stretches of text."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        # The byte-level alphabet writes printable bytes as themselves and the others, in order, from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        self.bytes_a = [bytes(byte[c] for c in self.a.id_to_token(k)) if all(c in byte for c in self.a.id_to_token(k)) else b"" for k in range(self.a.get_vocab_size())]
        self.fallback = np.array([self.b.is_byte(k) for k in range(self.b.vocab_size())])
        pieces = [self.b.id_to_piece(k) for k in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if f else p.replace("▁", " ").encode() for p, f in zip(pieces, self.fallback, strict=True)]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        # a piece with a blank after another character could cross a boundary: such a model gets whole texts
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.width = len(pieces)
        self.names = list(map(str, range(max(len(self.bytes_a), self.width))))
        if len(self.bytes_a) * self.width >= 2**32:
            raise ValueError("id pairs of these vocabularies do not fit 32 bits")
        self.forget()

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.numbers = np.zeros((0, 4), np.int32)  # tokens of A and B, groups, links; below 0: cannot be aligned
        self.written, self.written_to = np.zeros(0, np.uint8), np.zeros(1, np.uint32)
        self.links, self.links_to = np.zeros(0, np.uint32), np.zeros(1, np.uint32)

    def size(self) -> int:
        return sum(a.nbytes for a in (self.keys, self.at, self.numbers, self.written, self.written_to, self.links, self.links_to))

    def stretches(self, text: str) -> list[str]:
        """Stretches of blank + text; each begins with a blank, and only the last may end in white space. None is a lone blank, for which the model alone
        would give nothing."""
        if not self.parted:
            return [" " + text]
        found = [" " + w for w in text.split(" ")] if text[0] != " " and not UNSAFE.search(text) else BOUNDARY.split(" " + text)
        return [*found[:-2], found[-2] + " "] if len(found) > 1 and found[-1] == " " else found

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Token ids of A and B for a text that begins with a blank, and the byte offset where each ends; None where the bytes of A's or B's tokens are not the text's."""
        raw = text.encode()
        got = self.a.encode(text, add_special_tokens=False)
        list_a = got.ids
        pieces = np.array([(p.id, p.end) for p in self.b.encode(text[1:], return_type="proto").pieces], np.int64).reshape(-1, 2)
        ids_a, ids_b = np.array(list_a, np.int64), pieces[:, 0]
        if b"".join(map(self.bytes_a.__getitem__, list_a)) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) != raw:
            return None
        spans = np.array(got.offsets, np.int64).reshape(-1, 2)
        upto = np.arange(len(text) + 1) if len(raw) == len(text) else np.concatenate([[0], np.cumsum(UTF8[np.frombuffer(text.encode("utf-32-le"), "<u4").clip(max=0x10000)])])
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)  # the next token has a part of this one's last character
        ends_a = np.where(shared, np.cumsum(self.size_a[ids_a]), upto[spans[:, 1]])
        ends_b = np.where(self.fallback[ids_b], np.cumsum(self.size_b[ids_b]), pieces[:, 1] + 1)  # its spans count bytes, and do not count the blank
        return ids_a, ids_b, ends_a, ends_b

    def align(self, units: list[str]) -> Iterator[tuple[np.ndarray, bytes, np.ndarray, np.ndarray]]:
        """Of stretches: numbers, all groups as written and how long those of each are, all links as id pairs. They are tokenized together; if something does
        not fit, in halves."""
        found = self.ends("".join(units))
        until = np.cumsum([len(u.encode()) for u in units])
        if found is not None:
            ids_a, ids_b, ends_a, ends_b = found
            cuts = ends_a[np.isin(ends_a, ends_b, kind="table")]
            if np.isin(until, cuts, kind="table").all():
                yield self._groups(ids_a, ids_b, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), np.searchsorted(until, cuts), len(units))
                return
        if len(units) == 1:
            yield np.full((1, 4), -1), b"", np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        half = len(units) // 2
        yield from self.align(units[:half])
        yield from self.align(units[half:])

    def _groups(self, ids_a, ids_b, group_a, group_b, unit, n) -> tuple[np.ndarray, bytes, np.ndarray, np.ndarray]:
        """group_a, group_b: group of each token; unit: stretch of each group, none without any."""
        many_a, many_b = np.bincount(group_a, minlength=len(unit)), np.bincount(group_b, minlength=len(unit))
        to_a, to_b = np.cumsum(many_a), np.cumsum(many_b)
        first = np.searchsorted(unit, np.arange(n))
        numbers = np.stack([np.add.reduceat(of, first) for of in (many_a, many_b, np.ones(len(unit), np.int64), many_a * many_b)], axis=1)
        times = many_b[group_a]
        begin = np.repeat((to_b - many_b)[group_a] - (np.cumsum(times) - times), times)
        links = np.repeat(ids_a, times) * self.width + ids_b[begin + np.arange(len(begin))]
        name_a, name_b = (list(map(self.names.__getitem__, ids.tolist())) for ids in (ids_a, ids_b))
        written, a, b = [], 0, 0
        for x, y in zip(to_a.tolist(), to_b.tolist(), strict=True):
            written.append(f"{name_a[a] if x == a + 1 else ','.join(name_a[a:x])}|{name_b[b] if y == b + 1 else ','.join(name_b[b:y])};")
            a, b = x, y
        return numbers, "".join(written).encode(), np.add.reduceat(np.array(list(map(len, written))), first), links

    def places(self, units: list[str]) -> np.ndarray:
        """Place of each stretch among the remembered; new ones are aligned and remembered. Stretches are told apart by 64 bits of a keyed hash."""
        if self.size() > MEMO:
            self.forget()
        h = word_hashes(units)
        at = np.searchsorted(self.keys, h)
        known = np.zeros(len(h), bool) if len(self.keys) == 0 else self.keys[at.clip(max=len(self.keys) - 1)] == h
        if not known.all():
            new, first = np.unique(h[~known], return_index=True)
            where = np.flatnonzero(~known)[first]
            numbers, written, lengths, links, some, size = [], [], [], [], [], 0
            for k, place in enumerate(where):
                some.append(units[place])
                size += len(some[-1])
                if size > JOINED or k + 1 == len(where) or some[-1][-1].isspace():
                    for found in self.align(some):
                        for into, part in zip((numbers, written, lengths, links), found, strict=True):
                            into.append(part)
                    some, size = [], 0
            base = len(self.numbers)
            self.numbers = np.concatenate([self.numbers, *numbers], dtype=np.int32, casting="unsafe")
            many = self.numbers[base:, 3].astype(np.int64).clip(min=0)
            self.written_to = np.concatenate([self.written_to, self.written_to[-1] + np.cumsum(np.concatenate(lengths))], dtype=np.uint32, casting="unsafe")
            self.links_to = np.concatenate([self.links_to, self.links_to[-1] + np.cumsum(many)], dtype=np.uint32, casting="unsafe")
            self.written = np.concatenate([self.written, np.frombuffer(b"".join(written), np.uint8)])
            self.links = np.concatenate([self.links, *links], dtype=np.uint32, casting="unsafe")
            at = np.searchsorted(self.keys, new)
            self.keys, self.at = np.insert(self.keys, at, new), np.insert(self.at, at, base + np.arange(len(new), dtype=np.int32))
            at = np.searchsorted(self.keys, h)
        return self.at[at].astype(np.int64)


UTF8 = np.array([1 if c < 0x80 else 2 if c < 0x800 else 3 for c in range(0x10000)] + [4])  # bytes of a character


@functools.lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _gathered(values: np.ndarray, upto: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs values[upto[k]:upto[k + 1]] for each k in `at`, one after another, and their lengths."""
    first = upto[at].astype(np.int64)
    size = upto[at + 1] - first
    return values[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())], size


def aligned_texts(pair: Pair, texts: list[str]) -> tuple[list[list[str]], np.ndarray, list[memoryview], list[np.ndarray], list[np.ndarray]]:
    """Of each text: stretches, numbers (n_a, n_b, n_groups, n_links), groups as written, distinct links in order and how often each occurs."""
    parts = [pair.stretches(t) if t else [] for t in texts]
    lengths = np.array(list(map(len, parts)))
    doc = np.repeat(np.arange(len(texts)), lengths)
    units = [u for p in parts for u in p]
    at = pair.places(units) if units else np.zeros(0, np.int64)
    bad = np.zeros(len(texts), bool)
    bad[doc[pair.numbers[at, 0] < 0]] = True
    good = ~bad[doc]
    doc, at = doc[good], at[good]
    bound = np.searchsorted(doc, np.arange(len(texts) + 1))  # stretches come text by text
    numbers = np.diff(np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(pair.numbers[at], axis=0, dtype=np.int64)])[bound], axis=0)
    written, size = _gathered(pair.written, pair.written_to, at)
    ends = np.cumsum(np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64))
    views = [memoryview(written)[s:max(s, e - 1)] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    # a stretch that a text repeats is looked up once
    of, often = np.unique(doc * len(pair.numbers) + at, return_counts=True)
    place = of % max(1, len(pair.numbers))
    links, size = _gathered(pair.links, pair.links_to, place)
    room = len(pair.bytes_a) * pair.width
    key = np.repeat(of // max(1, len(pair.numbers)), size) * room + links.astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, often = key[order], np.repeat(often, size)[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.add.reduceat(often, new) if len(key) else often
    key = key[new]
    cut = np.searchsorted(key, np.arange(1, len(texts)) * room)
    return parts, numbers, views, np.split(key % room, cut), np.split(times, cut)


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u4").tobytes())


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64)


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(docs: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, with_groups: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """The kept columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row; `with_groups` adds `groups`, the text that is hashed.

    Texts that are null, empty or not what the tokens' bytes give (a text with U+2581, say) have no tokens: zeros and ''. The count of an id pair is
    the number of rows that hold it linked. Repeated rows count each. Result columns replace input columns of the same name; others do not matter. An
    empty table gives an empty result.

    One pass aligns and writes each row's links beside the counts of each task; both are read again. Counts are merged in parts of the id pairs.
    At most `frequent` pairs go to every task as an array, all others are joined by pair, which none of them makes hot. The best of each A id is at most
    one number for each entry of its vocabulary."""
    spark = docs.sparkSession
    parts = PARTS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = [*NUMBERS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else [])]
    carried = kept_columns(docs, keep, results)
    source = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(carried)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    own = source.schema.fields[:-1]
    fields = "part int, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, groups string, ids binary, times binary"
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in own], *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(path_a, path_b)
        pending, held = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            ids, n = np.unique(np.concatenate(pending), return_counts=True)
            part = ids % parts
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            blocks = [(int(part[x[0]]), _packed(np.diff(ids[x], prepend=0)), _packed(n[x])) for x in np.split(order, cut)]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(blocks), f.type) for f in list(arrow)[:len(own)]], pa.array([b[0] for b in blocks], pa.int32()), *[pa.nulls(len(blocks), f.type) for f in list(arrow)[len(own) + 1:-2]],
                                              pa.array([b[1] for b in blocks], pa.binary()), pa.array([b[2] for b in blocks], pa.binary())], schema=arrow)

        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size + len(texts[end]) <= SLICE):
                    size += len(texts[end])
                    end += 1
                _, numbers, views, ids, times = aligned_texts(pair, texts[start:end])
                pending += ids
                held += sum(map(len, ids))
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns[:-1], pa.nulls(end - start, pa.int32()), *[pa.array(numbers[:, k]) for k in range(4)],
                                                  pa.array([hashlib.sha256(v).hexdigest() if len(v) else "" for v in views]), pa.array([bytes(v).decode() if with_groups else None for v in views], pa.string()),
                                                  pa.array([_packed(np.diff(i, prepend=0)) for i in ids], pa.binary()), pa.array([_packed(t) for t in times], pa.binary())], schema=arrow)
                start = end
                if held > PENDING:
                    yield from counted()
                    pending, held = [], 0
        if held:
            yield from counted()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(ids: list, n: list) -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate(ids), return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, np.concatenate(n))
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(sums)], ["pair", "docs"])

        last, ids, n = None, [], []
        for batch in batches:  # sorted by part
            for part, i, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last and ids:
                    yield of(ids, n)
                    ids, n = [], []
                last = part
                ids.append(np.cumsum(_unpacked(i)))
                n.append(_unpacked(k))
        if ids:
            yield of(ids, n)

    done = cut_lineage(source.mapInArrow(run, schema))
    blocks = done.where("part is not null").select("part", "ids", "times")
    counts = cut_lineage(blocks.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "pair bigint, docs bigint"))
    pair = tokenizers(path_a, path_b)
    best = np.zeros(len(pair.bytes_a), np.int64)
    width = pair.width
    for r in counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("best")).collect():  # one row of each entry of A's vocabulary at most
        best[r["a"]] = r["best"]
    known_ids, known_docs = _most(counts, frequent)
    shared = spark.sparkContext.broadcast((best, known_ids, known_docs))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known_ids, known_docs = shared.value
        for batch in batches:
            out: dict[str, list] = {"row": [], "pair": [], "times": [], "n_best": [], "count_sum": []}
            for row, i, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, times = np.cumsum(_unpacked(i)), _unpacked(k)
                at = np.searchsorted(known_ids, ids).clip(max=max(0, len(known_ids) - 1))
                known = known_ids[at] == ids if len(known_ids) else np.zeros(len(ids), bool)
                docs_ = known_docs[at[known]] if len(known_ids) else np.zeros(0, np.int64)
                rest = np.flatnonzero(~known)
                top = docs_ == best[ids[known] // width]
                out["row"].append(np.full(len(rest) + 1, row))
                out["pair"].append(np.append(ids[rest], -1))
                out["times"].append(np.append(times[rest], 0))
                out["n_best"].append(np.append(np.zeros(len(rest), np.int64), times[known][top].sum()))
                out["count_sum"].append(np.append(np.zeros(len(rest), np.int64), (times[known] * docs_).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), pa.int64()) for v in out.values()], list(out))

    # the rows are read from a checkpoint, so their numbers are the same whenever they are read
    rows = done.withColumn("row", F.monotonically_increasing_id()).where("part is null")
    looked = rows.select("row", "ids", "times").mapInArrow(looked_up, "row bigint, pair bigint, times bigint, n_best bigint, count_sum bigint")
    bests = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a bigint, best bigint")
    rest = (looked.where("pair >= 0").join(counts, "pair").withColumn("a", F.expr(f"pair div {width}")).join(F.broadcast(bests), "a")
            .select("row", F.when(F.col("docs") == F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("docs")).alias("count_sum")))
    sums = looked.where("pair < 0").select("row", "n_best", "count_sum").unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.join(sums, "row").select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(carried)], *results)


def _most(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` pairs of the highest counts, sorted, with their counts: whole degrees of the count only, so the choice is one aggregate."""
    degree = F.floor(F.log2("docs") * 8)
    total, least = 0, None
    for c in counts.groupBy(degree.alias("degree")).count().orderBy(F.desc("degree")).collect():  # some hundred degrees at most
        total += c["count"]
        if total > most:
            break
        least = c["degree"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    got = counts.where(degree >= least).toArrow()
    ids, docs = got.column("pair").to_numpy(), got.column("docs").to_numpy()
    order = np.argsort(ids)
    return ids[order], docs[order]
