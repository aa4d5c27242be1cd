"""Compression bands: text that zstandard shrinks too well (repeated) or too little (noise), by limits that depend on its length."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwave.llm.common import map_texts

FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, "
          "ratio double, chunks_out double")


@dataclass(frozen=True)
class Bands:
    """Allowed ratios (bytes before : after) by the bit length of the byte count. A longer text shares more with itself, so the upper limit goes on
    rising by `rise` a bit; below `shortest` bits the frame of the format outweighs the text and only the upper limit holds. Ordinary wording
    repeats itself (terms, refrains), which gets `room` above `upper`, but not where over `symbol_share` of the bytes are symbols. Chunks catch
    what the whole text evens out: a text fails when over `chunk_share` of its bytes lie in chunks outside `chunk`. All bytes are judged, once in
    chunks of `chunk_bytes` and the rest, and, as junk is also hidden by its neighbours in a chunk, once more in up to `pieces` even pieces of
    `piece_bytes` or more; a shorter chunk has the lower limit of its length where that is less."""

    level: int = 3
    shortest: int = 9
    lower: tuple[float, ...] = (1.1, 1.2, 1.3, 1.35)  # from `shortest` on, the last one for all longer texts
    upper: tuple[float, ...] = (2.1, 2.2, 2.3, 2.36, 2.46, 2.56, 2.66, 2.76)  # likewise, and rising after the last one; the first one also below
    rise: float = 0.1
    room: float = 0.5
    symbol_share: float = 0.05
    chunk_bytes: int = 4096
    chunk: tuple[float, float] = (1.3, 3.0)
    chunk_share: float = 0.3
    pieces: int = 8
    piece_bytes: int = 256

    def limits(self, n_bytes: int, n_symbols: int = 0) -> tuple[float, float]:
        k = n_bytes.bit_length() - self.shortest
        more = self.rise * max(0, k - len(self.upper) + 1) + (self.room if n_symbols <= self.symbol_share * n_bytes else 0.0)
        return (self.lower[min(k, len(self.lower) - 1)] if k >= 0 else 0.0), self.upper[min(max(k, 0), len(self.upper) - 1)] + more

    def cuts(self, n_bytes: int) -> list[list[int]]:
        """Ends of the chunks, for each way of cutting."""
        ways = [[*range(self.chunk_bytes, n_bytes, self.chunk_bytes), n_bytes]]
        n = min(self.pieces, n_bytes // self.piece_bytes)
        if n > 1 and n_bytes < n * self.chunk_bytes:
            ways.append([n_bytes * k // n for k in range(1, n + 1)])
        return ways


def outside_share(data: bytes, press, bands: Bands) -> float:
    """Share of the bytes in chunks outside the limits, by the way of cutting that finds most."""
    low, high = bands.chunk
    most = 0
    for ends in bands.cuts(len(data)):
        start = off = 0
        for end in ends:
            n = end - start
            least = low if n >= bands.chunk_bytes else min(low, bands.limits(n)[0])
            if n and not least <= n / len(press(data[start:end])) <= high:
                off += n
            start = end
        most = max(most, off)
    return most / len(data) if data else 0.0


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur twice or more, first occurrences included."""
    if len(words) < 4:
        return 0
    codes: dict[bytes, int] = {}
    ids = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    pairs = ids[:-2] * len(codes) + ids[1:-1]
    if len(codes) >= 1 << 20:  # three codes no longer fit in 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, inverse, counts = np.unique(pairs * len(codes) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.zeros(len(ids), bool)
    again = counts[inverse] > 1
    for k in range(3):
        hit[k:len(ids) - 2 + k] |= again
    return int(hit.sum())


def judge(texts: list[str], bands: Bands) -> dict:
    import zstandard

    press = zstandard.ZstdCompressor(level=bands.level).compress
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "chunks_out")}
    for text in texts:
        data = text.encode()
        words = data.split()
        lines = [x for x in data.split(b"\n") if x and not x.isspace()]
        n, repeated = len(words), repeat_words(words)
        ratio = len(data) / len(press(data)) if data else None
        off = outside_share(data, press, bands)
        failed = n < 50 or 100 * repeated > 50 * n
        symbols = len(data) - len(data.translate(None, b"#*$%&|<>"))
        least, most = bands.limits(len(data), symbols)
        row = (n, len(text) - sum(map(data.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))), symbols,
               len(lines) - len(set(lines)), repeated, failed, not failed and least <= ratio <= most and off <= bands.chunk_share, ratio, off)
        for k, v in zip(out, row, strict=True):
            out[k].append(v)
    return out | {"ratio": pa.array(out["ratio"], pa.float64())}


def quality(docs: DataFrame, bands: Bands = Bands(), text: str = "text", keep=None) -> DataFrame:
    """Adds the base counts and the verdict `kept`. One pass without a shuffle; each row depends on its own text alone, so repeated rows get equal
    results. Null or empty text: no words, null ratio, base_failed."""
    return map_texts(docs, lambda texts: judge(texts, bands), FIELDS, text, keep)
