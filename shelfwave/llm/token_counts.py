"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies; no ids are kept.

A pre-token here is the stretch between two safe boundaries (before a blank that follows a character that is no white space): no match of a
byte-level split pattern and no special string crosses one, so a document's count is the sum over its stretches."""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwave.llm.common import map_texts
from shelfwave.session import cut_lineage

UNSAFE = re.compile(r"\s ")
BOUNDARY = re.compile(r"(?<=\S)(?= )")
FLUSH = 300_000
#: Frequent pre-tokens are looked up in each task; at most HEAVY, and HEAVY_BYTES with 64 each for what holds them.
HEAVY, HEAVY_BYTES, SEEN = 1 << 18, 32 << 20, 10_000
LONG, LONGS = 512, 20_000  # characters from which a pre-token is counted where it is; how many of these a worker remembers by 128 bits of a hash


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pretokens(text: str) -> Counter:
    """Frequencies of the text's pre-tokens; their concatenation in order is the text."""
    if not text:
        return Counter()
    if UNSAFE.search(text):
        return Counter(BOUNDARY.split(text))
    first, *rest = text.split(" ")
    found = Counter({" " + k: n for k, n in Counter(rest).items()})
    if first:
        found[first] += 1
    return found


def _pieces(units: list[str], path: str) -> list[int]:
    encode, n = tokenizer(path).encode_batch_fast, []
    for k in range(0, len(units), 1000):
        n += map(len, encode(units[k:k + 1000], add_special_tokens=False))
    return n


@functools.lru_cache(maxsize=1)
def _longs(path: str) -> dict[bytes, int]:
    return {}


def long_pieces(unit: str, path: str) -> int:
    """Pieces of a long pre-token: counted once in a worker, as far as it remembers."""
    known, name = _longs(path), hashlib.blake2b(unit.encode(), digest_size=16).digest()
    if name not in known:
        if len(known) >= LONGS:
            known.clear()
        known[name] = _pieces([unit], path)[0]
    return known[name]


def frequent(docs: DataFrame, path: str, text: str = "text", most: int = HEAVY, rows: int = SEEN) -> dict[str, int]:
    """Pieces of pre-tokens that are frequent in about `rows` rows, at most `most` of them. They are only looked up sooner than others: which they are
    changes no count."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                seen.update(u for u in pretokens(t) if len(u) < LONG)
                if len(seen) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "uses"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "uses"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pieces(batch.column(0).to_pylist(), path), pa.int64())], ["unit", "pieces"])

    every = max(1, docs.count() // rows)
    some = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(every)) == 0)
    uses = cut_lineage(some.select("t").mapInArrow(count, "unit string, uses bigint").groupBy("unit").agg(F.sum("uses").alias("uses")))
    degree = F.floor(F.log2("uses") * 8)
    total, size, least = 0, 0, None
    for c in uses.groupBy(degree.alias("degree")).agg(F.count("*").alias("units"), F.sum(F.octet_length("unit")).alias("bytes")).orderBy(F.desc("degree")).collect():  # some hundred degrees at most
        total, size = total + c["units"], size + c["bytes"] + 64 * c["units"]
        if total > most or size > HEAVY_BYTES:
            break
        least = c["degree"]
    if least is None:
        return {}
    picked = uses.where(degree >= least).select("unit").mapInArrow(pieces, "unit string, pieces bigint").toArrow()
    return dict(zip(picked.column(0).to_pylist(), picked.column(1).to_pylist(), strict=True))


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: int = HEAVY) -> DataFrame:
    """The kept columns, n_bytes and n_tokens of every row as the tokenizer file gives them, without added special tokens.

    Frequent pre-tokens are joined in the task to a broadcast of checked size (which they are is told by a count of the rows and a look at some of them
    while the plan is built). Very long ones, blank-free texts say, are counted where they are, once in a worker, so their strings never move. Every other
    (row, pre-token, frequency) is moved to its pre-token, where each distinct one is counted once; none of these is frequent, so no key is hot. Rows are told apart by their place in the input, which must be
    repeatable (a table, a checkpoint): repeated rows and null ids each keep a row. Null or empty text: 0 tokens. Result columns replace input columns
    of the same name."""
    carried = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, path, text, most) if most else {})
    full = F.coalesce(F.col(f"`{text}`"), F.lit(""))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = known.value
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                row, unit, uses = [], [], []
                for r, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = 0
                    for u, n in pretokens(t).items():
                        pieces = table.get(u) if len(u) < LONG else long_pieces(u, path)
                        if pieces is None:
                            row.append(r)
                            unit.append(u)
                            uses.append(n)
                        else:
                            found += n * pieces
                    row.append(r)
                    unit.append(str(r))  # what is counted already goes as a number below 0, to no pre-token of its own
                    uses.append(-1 - found)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(unit, pa.string()), pa.array(uses, pa.int64())], ["row", "unit", "uses"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, int] = (None, 0)
        for batch in batches:  # sorted by unit
            units, uses = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            here = list(dict.fromkeys(u for u, n in zip(units, uses, strict=True) if n >= 0))
            new = here[here[:1] == [last[0]]:]
            pieces = dict([last, *zip(new, _pieces(new, path), strict=True)])
            tokens = [n * pieces[u] if n >= 0 else -1 - n for u, n in zip(units, uses, strict=True)]
            if here:
                last = here[-1], pieces[here[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["row", "tokens"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`") for c in carried], full.alias("__text"))
    spread = numbered.select("row", "__text").mapInArrow(rows, "row bigint, unit string, uses bigint")
    sums = (spread.repartition("unit").sortWithinPartitions("unit").mapInArrow(joined, "row bigint, tokens bigint").groupBy("row").agg(F.sum("tokens").alias("n_tokens")))
    return (numbered.select("row", *[F.col(f"`{c}`") for c in carried], F.octet_length("__text").cast("long").alias("n_bytes")).join(sums, "row")
            .select(*[F.col(f"`{c}`") for c in carried], "n_bytes", "n_tokens"))


def plain_counts(docs: DataFrame, path: str, text: str = "text", keep=None) -> DataFrame:
    """The library's own count, text by text: what token_counts is tested against."""
    return map_texts(docs, lambda texts: {"n_tokens": [len(e) for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]}, "n_tokens bigint", text, keep)
