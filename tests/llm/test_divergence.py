"""The audit against plain counting, and the tree against a dense matrix."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import product

import numpy as np
import pytest

from shelfwave.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, value long, `group` string"


def plain(rows, least_docs, most_terms):
    docs = [((r[2] or ""), (r[3] or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in (r[1] or "")))) for r in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = {t for t, n in Counter(t for d in mine for t in set(d[2])).items() if n >= least_docs}
        uses = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, whole = {s: share(c) for s, c in uses.items()}, share(sum(uses.values(), Counter()))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in uses:
            pairs = sorted((-sum(f(shares[s][t], shares[o][t]) for t in kept), o.encode(), o) for o in uses if o != s)
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pairs)}
            terms = sorted((-f(shares[s][t], whole[t]), t.encode(), t) for t in kept if uses[s][t] and shares[s][t] > whole[t])
            out |= {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(terms[:most_terms])}
    return out


def made(seed: int, n: int):
    r = random.Random(seed)
    words = ["a", "B", "été", "Été", "straße", "x-y", "don't", "ÀB", "z" * 300, *(f"w{chr(97 + k)}{chr(97 + j)}" for k, j in product(range(9), range(9)))]
    return [(k, r.choice([None, "", "12 34 !?"]) if r.random() < 0.1 else " ".join(r.choices(words, k=r.randrange(40))), r.choice(["en", "en", "en", "de", None]),
             r.choice(["hot", "hot", "s1", "s2", "s3", "ü", None]), 1, "g") for k in range(n)]


@pytest.mark.parametrize("least,block,frontier", [(10, D.BLOCK, D.FRONTIER), (3, 40, 16)])
def test_equals_plain_counting(spark, monkeypatch, least, block, frontier):
    monkeypatch.setattr(D.Quadtree.joint, "__defaults__", (frontier,))
    rows = made(3, 120)
    rows += rows[:7]  # repeated rows count each
    rows.append((999, "only here", "xx", "alone"))  # a lang without kept terms and with one source
    rows[-1] += (1, "g")
    rows.append((1000, None, "xx", "other", 1, "g"))
    got = D.divergence(spark.createDataFrame(rows, SCHEMA), least, 4, block=block).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == plain(rows, least, 4)


def test_groups_joined_without_broadcast_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(D, "MOST_GROUPS", 0)
    rows = made(5, 60)
    assert {tuple(r) for r in D.divergence(spark.createDataFrame(rows, SCHEMA), 2).collect()} == plain(rows, 2, 10)
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_terms_of_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    text = "Abc defGHI  jkl9mno " * 5 + "p" * 50 + " é"
    assert [t for part in D.terms_of(text) for t in part] == [t.encode() for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower())]


@pytest.mark.parametrize("shape,frontier", [((1, 1), 10), ((20, 300), 50), ((300, 5), 1000), ((33, 33), 1)])
def test_tree_finds_every_shared_column_once(shape, frontier):
    dense = np.random.default_rng(sum(shape)).random(shape) < 0.2
    dense[0, 0] = True
    rows, columns = np.nonzero(dense)
    found = []
    for a, b in D.Quadtree.of(rows, columns).joint(frontier):
        assert (columns[a] == columns[b]).all() and (rows[a] < rows[b]).all()
        found += zip(rows[a].tolist(), rows[b].tolist(), columns[a].tolist(), strict=True)
    assert len(found) == len(set(found))
    assert set(found) == {(i, j, c) for c in range(shape[1]) for i in np.flatnonzero(dense[:, c]).tolist() for j in np.flatnonzero(dense[:, c]).tolist() if i < j}
