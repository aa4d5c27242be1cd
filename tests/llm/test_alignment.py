"""The alignment against token bytes laid end to end, text by text."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from shelfwave.llm import alignment as A

SCHEMA = "doc_id long, text string, n_a string, row long, c0 int"
ODD = ["", None, " ", "  ", "\n", " a  b ", "a▁b", "naïve café", "日本語 テキスト", "🙂🙃 x", "\x00\x01", "é a", "﻿x", "<s> <|endoftext|> </s>", "a" * 3000, " x  y", "tab\tx \ty", "👨‍👩‍👧", "", "x\r\n y",
       "don't we'll", "12 345", "ﬁ ½", "ẞß", "a b", "مرحبا بالعالم", "क्षत्रिय"]


@pytest.fixture(scope="module")
def pair():
    return A.Pair(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    words = ["the", "The", "of", "tion.", "über", "été", "niño", "日本", "🙂", "\n", "", "x" * 70, "▁", "-", "'s", "12"]
    return [r.choice(ODD) if r.random() < 0.3 else r.choice(["", " ", "\n"]) + r.choice([" ", " ", "  ", "\n"]).join(r.choices(words[:-4] if r.random() < 0.9 else words, k=r.randrange(1, 30))) for _ in range(n)]


def plain(pair, text):
    """Groups [(A ids, B ids)] of the whole text by the bytes of its tokens alone."""
    if not text:
        return []
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.bytes_a[k] for k in a) != raw or b"".join(pair.bytes_b[k] for k in b) != raw:
        return []
    groups, i, j, at_a, at_b, here = [], 0, 0, 0, 0, ([], [])
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            at_a += len(pair.bytes_a[a[i]])
            here[0].append(a[i])
            i += 1
        else:
            at_b += len(pair.bytes_b[b[j]])
            here[1].append(b[j])
            j += 1
        if at_a == at_b:
            groups.append(here)
            here = ([], [])
    return groups


def expected(pair, rows):
    groups = [plain(pair, r[1]) for r in rows]
    links = [Counter((a, b) for x, y in g for a in x for b in y) for g in groups]
    docs = Counter(p for c in links for p in c)
    best: dict = defaultdict(int)
    for (a, _), n in docs.items():
        best[a] = max(best[a], n)
    out = []
    for r, g, c in zip(rows, groups, links, strict=True):
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((r[0], sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), sum(c.values()), sum(n for (a, b), n in c.items() if docs[a, b] == best[a]), sum(n * docs[p] for p, n in c.items()),
                    hashlib.sha256(written.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("frequent", [A.FREQUENT, 50, 0])
def test_equals_plain_alignment(spark, pair, monkeypatch, frequent):
    rows = [(k if k % 9 else None, t, "old", 7, 1) for k, t in enumerate(texts(4, 150))]
    rows += rows[3:9]
    got = A.aligned(spark.createDataFrame(rows, SCHEMA).repartition(3), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), frequent=frequent, with_groups=True)
    assert got.columns == ["doc_id", "text", "row", "c0", *COLUMNS[1:], "groups"]
    found = got.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == expected(pair, rows)
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in found)


def test_small_slices_memory_and_joined_calls_change_nothing(pair, monkeypatch):
    many = texts(5, 120)
    whole = A.aligned_texts(pair, [t or "" for t in many])
    for name, value in (("JOINED", 5), ("MEMO", 2000)):
        monkeypatch.setattr(A, name, value)
    pair.forget()
    for k, t in enumerate(many):
        one = A.aligned_texts(pair, [t or ""])
        assert (one[1][0] == whole[1][k]).all() and bytes(one[2][0]) == bytes(whole[2][k])
        assert (one[3][0] == whole[3][k]).all() and (one[4][0] == whole[4][k]).all()


def test_spans_are_the_bytes_of_the_tokens(pair):
    for t in [t for t in [*ODD, *texts(6, 200)] if t]:
        got = pair.ends(" " + t)
        if got is not None:
            a, b, ends_a, ends_b = got
            assert ends_a.tolist() == [sum(map(len, (pair.bytes_a[k] for k in a[:i + 1]))) for i in range(len(a))]
            assert ends_b.tolist() == [sum(map(len, (pair.bytes_b[k] for k in b[:i + 1]))) for i in range(len(b))]


def test_empty_table(spark):
    assert A.aligned(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).collect() == []
