"""Source divergence: smoothed term shares of every (lang, source) group compared with those of the lang's other sources and of the lang.

The group-term counts form a sparse matrix. Blocks of its columns are held as K-squared trees (k = 2): each node has a bit for every quadrant that is
not all zero. Pairs of groups go down a tree together, only through quadrants where both have something; all else has the price of an absent term,
which is the same for every cell of a row, so it is priced by counting."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwave.session import cut_lineage

SCALE = 1_000_000_000
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 1 << 20  # bytes of a text that are split into terms at once
FLUSH = 200_000  # distinct terms a task holds at most before it hands them on
BLOCK = 200_000  # cells of a block of columns
FRONTIER = 500_000  # node pairs held at once while a tree is traversed
MOST_GROUPS = 100_000  # groups up to which their table (some 8 MB) is broadcast; beyond that it is joined by a shuffle


def terms_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text in lists of bounded size: runs of A-Z, a-z and characters from U+0080 on, A-Z as a-z."""
    raw = text.encode("utf-8", "surrogatepass").translate(LETTERS)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + PIECE) if len(raw) - start > PIECE else len(raw)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, uses, docs) of each task's documents, summed as far as a task's memory goes."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple, Counter] = defaultdict(Counter)
        seen: dict[tuple, Counter] = defaultdict(Counter)

        def flushed() -> Iterator[pa.RecordBatch]:
            for (of, at), found in uses.items():
                n = len(found)
                there = seen[of, at]
                yield pa.RecordBatch.from_arrays([pa.array([of] * n, pa.string()), pa.array([at] * n, pa.string()), pa.array(list(found), pa.binary()).cast(pa.string()),
                                                  pa.array(list(found.values()), pa.int64()), pa.array([there[t] for t in found], pa.int64())], ["lang", "source", "term", "uses", "docs"])
            uses.clear()
            seen.clear()

        for batch in batches:
            for of, at, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                here: set[bytes] = set()
                for part in terms_of(t):
                    uses[of, at].update(part)
                    here.update(part)
                seen[of, at].update(here)
            if sum(map(len, uses.values())) > FLUSH:
                yield from flushed()
        yield from flushed()

    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).alias("text")).mapInArrow(count, "lang string, source string, term string, uses bigint, docs bigint")


@dataclass
class Quadtree:
    """Levels of a K-squared tree over cells (row, column): of each node its four quadrant bits and where its children begin on the next level.
    Quadrant 2 r + c is row half r and column half c. The last level's children are the cells, in the order of `order`."""

    masks: list[np.ndarray]
    first: list[np.ndarray]
    order: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray) -> Quadtree:
        depth = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = np.zeros(len(rows), np.uint64)
        for b in range(depth):
            code |= (((rows >> b) & 1).astype(np.uint64) << np.uint64(2 * b + 1)) | (((columns >> b) & 1).astype(np.uint64) << np.uint64(2 * b))
        order = np.argsort(code)
        below, masks, first = code[order], [], []
        for _ in range(depth):
            nodes, at = np.unique(below >> np.uint64(2), return_inverse=True)
            mask = np.zeros(len(nodes), np.uint8)
            np.bitwise_or.at(mask, at, np.left_shift(1, below & np.uint64(3)).astype(np.uint8))
            masks.insert(0, mask)
            first.insert(0, np.concatenate([[0], np.cumsum(POPCOUNT[mask])[:-1]]))
            below = nodes
        return cls(masks, first, order)

    def joint(self, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells of one column in two different rows, as positions (a, b) with the lower row in a, in lists of bounded size. Goes down from the root in
        pairs of nodes that cover the same columns; a pair of which one has no bit for a quadrant ends there."""
        todo = [(0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            if level == len(self.masks):
                apart = a != b
                yield self.order[a[apart]], self.order[b[apart]]
                continue
            if len(a) > frontier:
                half = len(a) // 2
                todo += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            mask, first = self.masks[level], self.first[level]
            found = []
            for column in (0, 1):
                for ra, rb in ((0, 0), (0, 1), (1, 0), (1, 1)):
                    qa, qb = 2 * ra + column, 2 * rb + column
                    both = (mask[a] >> qa) & (mask[b] >> qb) & 1 == 1
                    if ra > rb:
                        both &= a != b  # a node with itself has each pair of its halves once
                    x, y = a[both], b[both]
                    found.append((first[x] + POPCOUNT[mask[x] & ((1 << qa) - 1)], first[y] + POPCOUNT[mask[y] & ((1 << qb) - 1)]))
            todo.append((level + 1, *(np.concatenate(side) for side in zip(*found, strict=True))))


POPCOUNT = np.array([bin(m).count("1") for m in range(256)], np.int64)


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _price(p: str, q: str) -> str:
    return f"((({p} - {q}) * ({p} - {q})) div ({p} + {q}))"


def _share(uses: str, n: str, v: str) -> str:
    """1 + floor(SCALE * (uses + 2) / (n + 2 v)), exact for counts beyond what SCALE times a long holds."""
    return f"1 + ((cast({uses} as decimal(20,0)) + 2) * cast({SCALE} as decimal(10,0))) div (cast({n} as decimal(20,0)) + 2 * cast({v} as decimal(20,0)))"


def _shared(cells: pd.DataFrame) -> pd.DataFrame:
    """Of a block: for each pair of groups the terms both have, priced as both have them and as if one had none."""
    p, none, row = cells["p"].to_numpy(np.int64), cells["none"].to_numpy(np.int64), cells["group"].to_numpy(np.int64)
    columns = np.unique(cells["term"].to_numpy(object), return_inverse=True)[1]
    names, local = np.unique(row, return_inverse=True)
    sums: dict[str, list] = {"a": [], "b": [], "shared": [], "gain": []}
    for a, b in Quadtree.of(local, columns).joint():
        pair, at = np.unique(local[a] * len(names) + local[b], return_inverse=True)
        gain, shared = np.zeros(len(pair), np.int64), np.bincount(at, minlength=len(pair))
        np.add.at(gain, at, price(p[a], p[b]) - price(p[a], none[b]) - price(none[a], p[b]))
        for k, v in zip(sums, (names[pair // len(names)], names[pair % len(names)], shared, gain), strict=True):
            sums[k].append(v)
    out = pd.DataFrame({k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in sums.items()})
    return out.groupby(["a", "b"], as_index=False).sum().assign(lang=cells["lang"].iloc[0])[["lang", "a", "b", "shared", "gain"]]


def divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source", block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the lang, by the divergence of the two groups' shares over all
    kept terms. Part `term`: the terms of which the group has more than its lang, by their price, the first `most_terms`.

    A lang keeps the terms of at least `least_docs` of its rows. Shares and prices are whole numbers, so sums do not depend on an order. Null lang,
    source and text count as ''. A group without terms has all shares alike; without any kept term pairs have value 0. Repeated rows count
    each. Other columns are not read. An empty table gives an empty result. A hot source or lang is summed in its tasks before anything moves; terms go to blocks
    of some `block` cells by hash, so no lang is one task's work. A block returns at most the square of its groups, as the result holds it anyway."""
    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    # one exchange: by (lang, term) the counts are summed by source and over the sources, of which a term has at most one row each
    counts = term_counts(docs, text, lang, source).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = cut_lineage(counts.select("lang", "term", "source", "uses", F.sum("docs").over(term).alias("docs"), F.sum("uses").over(term).alias("all_uses")).where(F.col("docs") >= least_docs).drop("docs"))
    every = docs.select(plain(lang).alias("lang"), plain(source).alias("source")).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("uses").alias("n"), F.count("*").alias("terms"))
    langs = cells.groupBy("lang", "term").agg(F.max("all_uses").alias("uses")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("uses").alias("all_n"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = cut_lineage(every.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "terms", "v", "all_n"])
                         .select("*", number.alias("group"), F.expr(f"case when v > 0 then {_share('0', 'n', 'v')} else 0 end").alias("none")))
    small = groups.count() <= MOST_GROUPS
    bounded = F.broadcast if small else (lambda df: df)
    priced = cut_lineage(cells.join(bounded(groups), ["lang", "source"])
                         .select("lang", "source", "term", "group", "none", F.expr(_share("uses", "n", "v")).alias("p"), F.expr(_share("all_uses", "all_n", "v")).alias("q")))

    blocks = max(1, priced.count() // block)
    dealt = priced.select("lang", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"), "term", "group", "none", "p")
    joint = (dealt.groupBy("lang", "block").applyInPandas(_shared, "lang string, a bigint, b bigint, shared bigint, gain bigint")
             .groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"), F.sum("gain").alias("gain")))
    joint = joint.unionByName(joint.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "shared", "gain"))
    # a group's terms against a group that has none of them: one price for each count that occurs
    alike = priced.groupBy("lang", "group", "p").agg(F.count("*").alias("times"))
    sides = groups.select("lang", F.col("group").alias("b"), F.col("none").alias("none_b"))
    alone = alike.join(bounded(sides), "lang").where("group <> b").groupBy("lang", F.col("group").alias("a"), "b").agg(F.sum(F.expr(f"times * {_price('p', 'none_b')}")).alias("alone"))
    back = alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("back"))
    one = groups.select("lang", "source", F.col("group").alias("a"), "v", F.col("terms").alias("terms_a"), F.col("none").alias("none_a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("group").alias("b"), F.col("terms").alias("terms_b"), F.col("none").alias("none_b"))
    keys = ["lang", "a", "b"]
    pairs = (one.join(bounded(other), "lang").where("a <> b").join(alone, keys, "left").join(back, keys, "left").join(joint, keys, "left").na.fill(0, ["alone", "back", "shared", "gain"])
             .withColumn("value", F.expr(f"case when v = 0 then 0 else alone + back + gain + (v - terms_a - terms_b + shared) * {_price('none_a', 'none_b')} end")))
    above = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_price("p", "q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), rank.alias("rank"))
    return ranked(pairs, "pair").unionByName(ranked(above, "term").where(F.col("rank") <= most_terms))
