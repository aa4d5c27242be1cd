"""The run-length index against sets of strings."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from shelfwave.llm import runindex as R, sharing

SCHEMA = "doc_id long, text string, n_bytes string, key int, rid string, c0 int"


def plain(rows, length):
    least: dict[bytes, int] = {}
    for k, t, *_ in rows:
        raw = (t or "").encode()
        if k is not None:
            for p in range(len(raw) - length + 1):
                least[raw[p:p + length]] = min(k, least.get(raw[p:p + length], k))
    out = []
    for k, t, *_ in rows:
        raw = (t or "").encode()
        off = np.zeros(len(raw), bool)
        if k is not None:
            for p in range(len(raw) - length + 1):
                if least[raw[p:p + length]] < k:
                    off[p:p + length] = True
        spans = int((np.diff(np.concatenate([[False], off, [False]]).astype(int)) == 1).sum())
        out.append((k, len(raw), int(off.sum()), spans, hashlib.sha256(bytes(b for b, o in zip(raw, off, strict=True) if not o)).hexdigest()))
    return sorted(out, key=str)


def texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    words = ["alpha", "be", "über", "日本", "gamma delta", "x", "\x00", "\n", "e" * 9, "🙂"]
    passage = [" ".join(r.choices(words, k=r.randrange(8, 60))) for _ in range(6)]
    made: list = [None, "", "a" * 49, "a" * 50, "a" * 400, "a" * 130, "ab" * 90, passage[0][:30]]
    for _ in range(n):
        if made and r.random() < 0.1:
            made.append(r.choice(made))
            continue
        t = " ".join(r.choices(words, k=r.randrange(40)))
        for _ in range(r.randrange(3)):
            at, p = r.randrange(len(t) + 1), r.choice(passage)
            t = t[:at] + p[r.randrange(5):] + t[at:]
        made.append(t)
    return made


def rows_of(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed + 1)
    made = texts(seed, n)
    keys = r.sample(range(-50, 5 * len(made)), len(made))
    rows = [(k if r.random() > 0.05 else None, t, "old", 1, "r", 2) for k, t in zip(keys, made, strict=True)]
    rows += rows[2:9]  # repeated rows
    rows.append((rows[-1][0], "another text of the same key " * 5, "old", 1, "r", 2))
    return rows


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("hot,chunk,slice_,block", [(R.HOT, R.CHUNK, R.SLICE, R.BLOCK), (3, 300, 900, 70), (0, 1, 1, R.BLOCK)])
def test_equals_sets_of_strings(spark, monkeypatch, hot, chunk, slice_, block):
    for name, value in (("HOT", hot), ("CHUNK", chunk), ("SLICE", slice_), ("BLOCK", block)):
        monkeypatch.setattr(R, name, value)
    monkeypatch.setattr(sharing, "SLICE", slice_)
    rows = rows_of(2, 90)
    got = R.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3), with_text=True)
    assert got.columns == ["doc_id", "text", "key", "rid", "c0", *COLUMNS[1:], "kept"]
    found = got.collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in found), key=str) == plain(rows, 50)
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)


def test_other_length_and_empty_table(spark):
    rows = rows_of(8, 40)
    got = R.without_repeats(spark.createDataFrame(rows, SCHEMA), length=33)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=str) == plain(rows, 33)
    assert R.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("block,stretch", [(R.BLOCK, R.STRETCH), (61, 7)])
def test_every_string_has_the_anchor_of_its_copies(monkeypatch, block, stretch):
    monkeypatch.setattr(R, "BLOCK", block)
    monkeypatch.setattr(R, "STRETCH", stretch)
    of: dict[bytes, int] = {}
    for t in texts(4, 60):
        raw = (t or "").encode()
        h, first, many = R.anchors(raw)
        assert many.sum() == max(0, len(raw) - 49) and (first == np.cumsum(many) - many).all() and many.max(initial=0) <= stretch
        for a, f, m in zip(h.tolist(), first.tolist(), many.tolist(), strict=True):
            for p in range(f, f + m):
                assert of.setdefault(raw[p:p + 50], a) == a


@pytest.mark.parametrize("length", [9, 16, 50])
def test_index_tells_the_least_owner_of_every_string(length):
    r = random.Random(length)
    for _ in range(30):
        base = bytes(r.choices(b"ab\x00\xff", k=200))
        stretches = list({(lambda s: base[s:s + length + r.randrange(30)])(r.randrange(100)) + bytes(r.choices(b"ab", k=r.randrange(4))) for _ in range(40)})
        owner = np.array([r.randrange(20) for _ in stretches])
        many = np.array([len(s) - length + 1 for s in stretches])
        begin = np.cumsum(many + length - 1) - (many + length - 1)
        text = np.frombuffer(b"".join(stretches), np.uint8)
        index = R.RunIndex.of(text, begin, many, owner, length)
        least: dict[bytes, int] = {}
        for s, o in zip(stretches, owner.tolist(), strict=True):
            for p in range(len(s) - length + 1):
                least[s[p:p + length]] = min(o, least.get(s[p:p + length], o))
        assert index.least_owners(text, begin, many).tolist() == [least[s[p:p + length]] for s in stretches for p in range(len(s) - length + 1)]
        assert len(index.place) <= int(index.size.sum())


def test_runs_are_fewer_than_places_in_repetitive_text():
    r = random.Random(1)
    base = bytes(r.choices(range(97, 123), k=3000))
    stretches = [base[s:s + 110] for s in range(0, 2800, 7)]
    many = np.full(len(stretches), 61)
    index = R.RunIndex.of(np.frombuffer(b"".join(stretches), np.uint8), 110 * np.arange(len(stretches)), many, np.zeros(len(stretches), np.int64), 50)
    assert index.size.sum() < many.sum() / 5 and len(index.place) <= index.size.sum()


@pytest.mark.parametrize("parcel", [R.PARCEL, 1, 900])
def test_parcels_hold_every_row_and_equal_stretches_once(monkeypatch, parcel):
    import pyarrow as pa

    monkeypatch.setattr(R, "PARCEL", parcel)
    r, groups = random.Random(parcel), 3
    known = [(r.randrange(1 << 40), bytes(r.choices(b"abc", k=50 + r.randrange(60)))) for _ in range(12)]
    rows = [(*r.choice(known), r.randrange(-5, 5), r.choice([-1, 1]) * r.randrange(1 << 62), r.randrange(1 << 31)) for _ in range(300)]
    names = ["code", "bytes", "key", "rid", "start"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k:k + 70], strict=True), (pa.int64(), pa.binary(), *[pa.int64()] * 3), strict=True)], names) for k in range(0, 300, 70)]
    batches.insert(1, batches[0].slice(0, 0))
    sent: dict[int, list] = {}
    for b in R.parcels(iter(batches), groups):
        for part, size, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            sent.setdefault(part, []).append((size, packed))
    got = []
    for part, packed in sent.items():
        raw, place, size, at, numbers = R.unpacked(packed)
        assert all((c >> 32) % groups == part for c in numbers[0].tolist())
        if parcel > 10**6:
            assert len(raw) == sum(len(b) for b in {b for c, b in known if (c >> 32) % groups == part and any(x[0] == c for x in rows)})
        got += [(c, raw[place[a]:place[a] + size[a]], k, i, s) for a, (c, k, i, s) in zip(at.tolist(), numbers.T.tolist(), strict=True)]
    assert sorted(got) == sorted(rows)
