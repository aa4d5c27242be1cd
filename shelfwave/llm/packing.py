"""Sum-of-squares packing of token streams into fixed windows.

Each document goes, online, to the fill level that keeps the sum of the squared counts of partly filled windows least; a level array holds those
counts. What is longer than a window fills whole windows first. At the end of a partition the windows still open are emptied into each other, so
cuts are rare and nothing is padded."""

from __future__ import annotations

import functools
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwave.llm.token_counts import tokenizer

WINDOW, END = 2048, 1
CACHE, LONG = 250_000, 64  # distinct words, and distinct pieces of words, that a task remembers, each below LONG characters: some 90 MB
PLAIN = re.compile(r"[!-~¡-¬®-ÿ]+")  # printable Latin-1: no white space, nothing to normalise but case


class WordIds:
    """Ids of a word-level BPE tokenizer file as little-endian unsigned 32-bit bytes, remembered by unit. Plain Latin units are split by the file's
    own pattern and given to its model; all others go through the whole library."""

    def __init__(self, path: str):
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        import json

        import regex

        self.library = tokenizer(path)
        with open(path, encoding="utf-8") as spec:
            split = next(p for p in json.load(spec)["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"]).findall
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # the byte alphabet of byte-level models
        rest = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.units: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.again: set[str] = set()  # units that were known when a text had them

    def unit(self, unit: str) -> bytes:
        if PLAIN.fullmatch(unit) and "<|" not in unit:
            known = self.pieces
            low = unit.lower()
            if low.isalpha():
                return known.get(low) or self.piece(low)
            return b"".join([known.get(p) or self.piece(p) for p in self.split(low)])
        return array("I", self.library.encode(unit, add_special_tokens=False).ids).tobytes()

    def piece(self, piece: str) -> bytes:
        tokens = self.library.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))
        got = array("I", [t.id for t in tokens]).tobytes()
        if len(piece) < LONG:
            self.pieces[piece] = got
        return got

    def forget(self) -> None:
        """Only units met in several texts stay. A worker lives on after its task, and what it remembers adds to what the session's other work needs."""
        often = self.again if len(self.again) <= CACHE // 4 else ()
        self.units = {u: self.units[u] for u in often if u in self.units}
        self.pieces = {p: ids for p, ids in self.pieces.items() if p in self.units}
        self.again = set()

    def __call__(self, text: str) -> bytes:
        # the tokenizer drops white space and nothing it matches crosses a blank or line end, so units do not depend on their neighbours
        if max(len(self.units), len(self.pieces)) > CACHE:
            self.forget()
        units, known = text.replace("\n", " ").split(" "), self.units
        distinct = set(units)
        new, here = distinct.difference(known), known
        self.again |= distinct - new
        if len(new) > CACHE or any(len(u) >= LONG for u in new):  # these are for this text alone
            here = {u: known[u] if u in known else self.unit(u) for u in distinct}
        else:
            for u in new:
                known[u] = self.unit(u)
        return b"".join(map(here.__getitem__, units))


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Packer:
    """Windows of one partition. Pieces are (document, start, length, sequence, offset)."""

    def __init__(self, window: int = WINDOW):
        self.window, self.sequence = window, 0
        self.levels = np.zeros(window + 1, np.int64)  # open windows by fill; 0 and window stay 0
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # their pieces, newest last

    def _close(self, pieces) -> Iterator[tuple]:
        offset = 0
        for doc, start, length in pieces:
            yield doc, start, length, self.sequence, offset
            offset += length
        self.sequence += 1

    def add(self, doc, length: int) -> Iterator[tuple]:
        """Pieces of windows that this document fills."""
        whole = length // self.window * self.window
        for start in range(0, whole, self.window):
            yield from self._close([(doc, start, self.window)])
        rest = length - whole
        if not rest:
            return
        # putting `rest` on level h changes the sum by 1 - 2 N(h) + 1 + 2 N(h + rest); a full window counts nothing, as does level 0
        n, top = self.levels, self.window - rest
        cost = 2 - 2 * n[:top + 1] + 2 * n[rest:]
        cost[0] = 1 + 2 * n[rest]
        cost[top] = 1 - 2 * n[top]
        cost[1:][n[1:top + 1] == 0] = np.iinfo(np.int64).max
        if top == 0:
            cost[0] = 0
        best = int(top - np.argmin(cost[::-1]))  # of equal costs the fullest window
        pieces = []
        if best:
            pieces = self.open[best].pop()
            n[best] -= 1
        pieces.append((doc, whole, rest))
        if best + rest == self.window:
            yield from self._close(pieces)
        else:
            self.open[best + rest].append(pieces)
            n[best + rest] += 1

    def drain(self) -> Iterator[tuple]:
        """Empties the open windows: the least filled are cut up to fill the fullest; what is left at last goes to windows of powers of two."""
        left = [w for level in self.open for w in level]  # by fill
        fill = [sum(p[2] for p in w) for w in left]
        self.open, self.levels = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, np.int64)
        lo, hi, spare = 0, len(left) - 1, []
        while lo < hi or (spare and lo <= hi):
            need = self.window - fill[hi]
            while need and (spare or lo < hi):
                if not spare:
                    spare = list(left[lo])
                    lo += 1
                doc, start, length = spare.pop()
                take = min(need, length)
                left[hi].append((doc, start, take))
                if take < length:
                    spare.append((doc, start + take, length - take))
                need -= take
            if need:
                fill[hi] = self.window - need
                break
            yield from self._close(left[hi])
            hi -= 1
        rest = spare + (left[hi] if lo <= hi else [])
        total = sum(p[2] for p in rest)
        for bit in range(total.bit_length() - 1, -1, -1):
            if not total >> bit & 1:
                continue
            room, pieces = 1 << bit, []
            while room:
                doc, start, length = rest.pop()
                take = min(room, length)
                pieces.append((doc, start, take))
                if take < length:
                    rest.append((doc, start + take, length - take))
                room -= take
            yield from self._close(pieces)


def packed(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the piece's ids (binary).

    Every partition of the input packs its own rows in one pass without a shuffle and holds the open windows only (below `window` of them, plus their
    pieces' ids); a sequence belongs to one partition, whose number is in the upper bits of its id. Null or empty text: the end id alone. Repeated rows
    and null keys each get pieces of their own. An empty table gives none."""
    fields = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + (", ids binary" if with_ids else "")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(fields).fields])
    source = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, ids_of = to_arrow_schema(schema), word_ids(path)
        packer, base, tail = Packer(window), TaskContext.get().partitionId() << 33, np.array([end], "<u4").tobytes()

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            rows = []
            for (k, ids, whole), start, length, sequence, offset in pieces:
                own = ids[4 * (start - whole):4 * (start - whole + length)]
                rows.append((k[0], start, length, zlib.crc32(own), k[1], base + sequence, offset, own)[:len(arrow)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], arrow.names)

        done: list[tuple] = []
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = ids_of(t) + tail
                n = len(ids) // 4
                whole = n // window * window
                for piece in packer.add(((k, n), ids, 0), n) if not whole else _split(packer, k, n, ids, whole, window):
                    done.append(piece)
                if len(done) >= 2000:
                    yield batch_of(done)
                    done = []
        done += packer.drain()
        if done:
            yield batch_of(done)
        ids_of.forget()

    return source.mapInArrow(run, schema)


def _split(packer: Packer, k, n: int, ids: bytes, whole: int, window: int) -> Iterator[tuple]:
    """A long document: the open part keeps the ids of its rest alone."""
    rest = ((k, n), ids[4 * whole:], whole)
    for doc, start, length, sequence, offset in packer.add(rest, n):
        if doc is rest and start < whole:
            doc = ((k, n), ids[4 * start:4 * (start + length)], start)
        yield doc, start, length, sequence, offset
