"""Operators that can be checked text by text: against brute force, the libraries themselves or exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

WORDS = "Ouan de ça élan the of Straße über niño and it's we'll 12 3.5 100,000 foo_bar (x) -- <|endoftext|> é ﬁ İ ǅ 漢字 한글 😀 á     \x1c \x85 x\ty l’été".split(" ")


def texts(seed=3, n=60):
    r = random.Random(seed)
    out = [None, "", " ", "  \n\n  ", "a", "a b", "word", "<|endoftext|>", "x <|endoftext|> y", "a  b   c", "tail  ", "\n lead", "z" * 3000, "é" * 500 + " " + "ab" * 900, "+ - * / " * 400]
    for _ in range(n):
        gap = [" "] * 8 + ["  ", "\n", "\n\n", " \n", "\t", "\r\n"]
        out.append("".join(r.choice(WORDS) + r.choice(gap) for _ in range(r.randrange(1, 120))))
    return out + out[20:26]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, repeated rows, equal ids, and columns whose names clash with results."""
    rows = [(k if k % 9 else 4, t, None if k % 3 else "en", None, k, "x", "y", 7.0) for k, t in enumerate(texts())]
    rows += [(None, "null id", None, None, None, None, None, None), rows[30], rows[30], (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens string, shard string, ids double").repartition(3)


@pytest.fixture(scope="module")
def table(docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    docs.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def pairs(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def test_token_counts_equal_the_library(table):
    from shelfwave.llm.token_counts import plain_counts, pretokens, token_counts

    for t in texts():
        assert sum(len(u) * n for u, n in pretokens(t or "").items()) == len(t or "")
    path = P.path("byte_bpe_50k.json")
    expected = pairs(plain_counts(table, path, keep=["doc_id"]), "doc_id", "n_tokens")
    for most in (0, 20, 1 << 17):  # all joined, some joined, all looked up
        assert pairs(token_counts(table, path, most=most), "doc_id", "n_tokens") == expected


def test_token_counts_of_an_empty_table(table):
    from shelfwave.llm.token_counts import token_counts

    assert token_counts(table.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def plain_encoding(name="byte_bpe_multi_50k.tiktoken"):
    from shelfwave.llm.bpe import encoding

    return encoding(P.path(name), P.PATTERN)


def test_bpe_equals_the_library_and_comes_back(table):
    from shelfwave.llm.bpe import decoded, encoded, round_trip

    path, enc = P.path("byte_bpe_multi_50k.tiktoken"), plain_encoding()
    rows = encoded(table, path, P.PATTERN, keep=["doc_id", "text"])
    back = decoded(rows, path, P.PATTERN).collect()
    assert len(back) == table.count()
    for r in back:
        assert np.frombuffer(r["ids"], "<u4").tolist() == enc.encode_ordinary(r["text"] or "")
        assert r["bytes"].decode() == (r["text"] or "")
    for r in round_trip(table, path, P.PATTERN, keep=["text"]).collect():
        ids = enc.encode_ordinary(r["text"] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert encoded(table.limit(0), path, P.PATTERN).count() == 0


def test_long_texts_are_cut_where_no_match_crosses():
    from shelfwave.llm.bpe import encode, parts

    enc = plain_encoding()
    for t in filter(None, texts(5, 120)):
        assert "".join(parts(t, 7)) == t
        assert [i for p in parts(t, 7) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    long = " ".join(filter(None, texts(6, 400))) * 4
    assert encode(long, enc).tolist() == enc.encode_ordinary(long)


def test_decoding_halves_of_a_character(spark):
    from shelfwave.llm.bpe import decoded

    enc = plain_encoding()
    ids = enc.encode_ordinary("☃ snow")
    rows = spark.createDataFrame([(1, np.array(ids[:1], "<u4").tobytes()), (2, None)], "k int, ids binary")
    got = {r["k"]: r["bytes"] for r in decoded(rows, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    assert got == {1: enc.decode_single_token_bytes(ids[0]), 2: b""}


def brute_quality(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    hit = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), len(words) < 50 or 100 * len(hit) > 50 * len(words)


def test_quality_counts_and_bands(table, spark):
    from shelfwave.llm.quality import Bands, quality

    got = quality(table, keep=["text"]).collect()
    assert len(got) == table.count()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(r["text"] or "")
        assert not (r["base_failed"] and r["kept"])
    r = random.Random(1)
    prose = " ".join("".join(r.choices("etaoinshrdlu", k=r.randrange(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(r.randrange(33, 127)) for _ in range(12)) for _ in range(500))
    stamped = prose + "\n" + "".join(f"{r.randrange(10)} the same long line over and over again with a number\n" for _ in range(300))
    rows = spark.createDataFrame([("prose", prose), ("noise", noise), ("stamped", stamped)], "name string, text string")
    wide = Bands(upper=(3.0,))
    assert {r["name"]: r["kept"] for r in quality(rows, wide).collect()} == {"prose": True, "noise": False, "stamped": False}
    assert quality(table.limit(0)).count() == 0


def test_packing_places_every_id_once_without_padding(table):
    from shelfwave.llm.packing import packed, word_ids
    from shelfwave.llm.token_counts import tokenizer

    path = P.path("word_bpe_49k.json")
    encode = lambda t: [*tokenizer(path).encode(t or "", add_special_tokens=False).ids, 1]
    for t in texts(8, 200):
        assert np.frombuffer(word_ids(path)(t or ""), "<u4").tolist() + [1] == encode(t)
    for window in (16, 2048):
        unique = table.withColumn("doc_id", F.monotonically_increasing_id())
        rows = packed(unique, path, window=window, with_ids=True).collect()
        source = {r["doc_id"]: encode(r["text"]) for r in unique.collect()}
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_seq.setdefault(r["sequence_id"], []).append(r)
            assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        assert by_doc.keys() == source.keys()
        for k, mine in by_doc.items():
            mine.sort(key=lambda r: r["start"])
            assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in mine]).tolist() == source[k]
            assert all(r["doc_tokens"] == len(source[k]) and r["start"] == sum(x["length"] for x in mine[:j]) for j, r in enumerate(mine))
        for mine in by_seq.values():
            mine.sort(key=lambda r: r["offset"])
            assert all(r["offset"] == sum(x["length"] for x in mine[:j]) for j, r in enumerate(mine))
            total = sum(r["length"] for r in mine)
            assert total <= window and total & (total - 1) == 0
    assert packed(table.limit(0), path).count() == 0


def test_sum_of_squares_choice():
    from shelfwave.llm.packing import Packer

    packer, r = Packer(64), random.Random(4)
    for k in range(400):
        length, before = r.randrange(1, 64), packer.levels.copy()
        list(packer.add(k, length))
        def after(h, n=before):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + length < 64:
                m[h + length] += 1
            return int((m ** 2).sum())
        allowed = [after(h) for h in range(65 - length) if h == 0 or before[h]]
        assert int((packer.levels ** 2).sum()) == min(allowed)


def test_sketches(table):
    from shelfwave.llm import sketch as S

    assert S.fingerprint("abc") == S.fingerprint("abc") != S.fingerprint("abd")
    r = random.Random(2)
    a, b = ("".join(r.choices("abcdefgh ", k=20000)) for _ in range(2))
    va, vb, vs = S.sketch(a), S.sketch(b), S.sketch(a[:5000])
    assert S.values_of(S.fingerprint(a)).tolist() == va.tolist()
    assert S.containment(vs, va) > 0.97 and S.containment(va, vs) == pytest.approx(0.25, abs=0.05) and S.likeness(va, vb) < 0.01
    assert S.merged(va, vb).tolist() == sorted({*va.tolist(), *vb.tolist()})
    assert S.fingerprints(table, keep=["doc_id"]).count() == table.count()


def test_edits_follow_the_order_of_ids(spark, table):
    from shelfwave.llm import sketch as S

    rows = [(k, t) for k, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    for bins in (1, 5, 40):
        got = {r["doc_id"]: r for r in S.with_edits(spark.createDataFrame(rows, "doc_id bigint, text string"), bins=bins).collect()}
        order = sorted((k, t or "") for k, t in rows)
        assert len(got) == len(order)
        for j, (k, t) in enumerate(order):
            after = order[(j + 1) % len(order)][1]
            half = len(t) // 2
            edited = t[:len(t) - half] + after[:half]
            r = got[k]
            assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), S.fingerprint(t), S.fingerprint(edited))
            assert 0 <= r["near_next"] <= 1 and (edited != t or r["near_edited"] == 1)
    assert S.with_edits(table, bins=4).count() == table.count()
    assert S.with_edits(table.limit(0)).count() == 0


def test_shards_hold_near_equal_bytes(spark, table):
    from shelfwave.llm.shards import sharded

    r = random.Random(9)
    rows = [(k * k, "x" * r.randrange(2000)) for k in range(3000)] + [(77, "y" * k) for k in range(1500)]  # one key holds a third of all rows
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = sharded(df, 7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g)
    sums = [sum(g["size"] for g in by[s]) for s in range(7)]
    assert max(sums) - min(sums) <= 2 * 2016 + 0.004 * sum(sums) / 7
    last = None
    for s in range(7):
        assert sorted(g["slot"] for g in by[s]) == list(range(len(by[s])))
        keys = [g["doc_id"] for g in sorted(by[s], key=lambda g: g["slot"])]
        assert keys == sorted(keys) and (last is None or last <= keys[0])
        last = keys[-1]
    odd = sharded(table, 5)
    assert odd.count() == table.count() and odd.columns.count("shard") == 1 and dict(odd.dtypes)["shard"] == "int"
    assert sharded(table.limit(0), 5).count() == 0
    assert {r["shard"] for r in sharded(table.limit(1), 5).collect()} <= set(range(5))


def test_a_third_of_all_rows_equal_in_every_column_is_parted(spark, tmp_path):
    from shelfwave.llm.shards import sharded

    rows = [(7, "x" * 500) if k % 3 == 0 else (k % 40 if k % 3 == 1 else None, "y" * (k % 90)) for k in range(6000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(path)
    got = sharded(spark.read.parquet(path), 40).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(rows, key=str)
    total = sum(r["size"] for r in got)
    for s in range(40):
        own = [r for r in got if r["shard"] == s]
        assert abs(sum(r["size"] for r in own) - total / 40) <= 2 * 516 + total / 40 / 500
        assert sorted(r["slot"] for r in own) == list(range(len(own)))


@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_key_is_cut_in_text_order(spark, hot):
    from shelfwave.llm import sketch as S
    from shelfwave.llm.common import interval

    r = random.Random(4)
    rows = [(hot, "".join(r.choices("aé日b ", k=r.randrange(2, 30)))) for _ in range(120)] + [(k, f"t{k}" * (k % 9)) for k in range(240) if k != 7]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    order = sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[1].encode()))
    want = Counter()
    for j, (k, t) in enumerate(order):
        half, after = len(t) // 2, order[(j + 1) % len(order)][1]
        want[k, len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    got = S.with_edits(frame, bins=12)
    assert Counter((x["doc_id"], x["n_chars"], x["edited_sha256"]) for x in got.collect()) == want
    placed = frame.selectExpr("coalesce(doc_id, cast(-9223372036854775808 as bigint)) as __order", "text").withColumn(
        "__tie", F.conv(F.rpad(F.hex(F.substring(F.col("text").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"))
    bins = placed.where(F.col("__order") == (7 if hot else -(2**63))).groupBy(interval(S._cuts(placed, 12))(F.col("__order"), F.col("__tie"))).count().collect()
    assert len(bins) >= 3 and max(b["count"] for b in bins) < 80


def test_likeness_is_near_the_exact_resemblance():
    from shelfwave.llm import sketch as S

    r = random.Random(6)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for _ in range(12):
            a = "".join(r.choices("abcdefgh ", k=6000))
            b = a[:int(6000 * share)] + "".join(r.choices("abcdefgh ", k=6000 - int(6000 * share)))
            x, y = (set(S.shingle_hashes(t).tolist()) for t in (a, b))
            errors.append(S.likeness(S.sketch(a), S.sketch(b)) - len(x & y) / len(x | y))
        assert abs(sum(errors) / len(errors)) < 0.02 and max(map(abs, errors)) < 0.12  # some 375 hashes of 6,000 are kept on each side


def test_a_long_pretoken_in_a_third_of_the_rows_stays_in_its_task(spark, tmp_path, monkeypatch):
    from shelfwave.llm import token_counts as C

    path = P.path("byte_bpe_50k.json")
    r = random.Random(8)
    long = "".join(r.choices("abcdé漢", k=10_000))
    rows = [(k, f"some {long} text {k}" if k % 3 == 0 else f"w{k} " * (k % 20) + "u" * (k % 700)) for k in range(90)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "rows"))
    frame = spark.read.parquet(str(tmp_path / "rows"))
    want = {x["doc_id"]: x["n_tokens"] for x in C.plain_counts(frame, path, keep=["doc_id"]).collect()}
    for most in (C.HEAVY, 0):
        assert {x["doc_id"]: x["n_tokens"] for x in C.token_counts(frame, path, most=most).collect()} == want
    assert not any(len(u) >= C.LONG for u in C.frequent(frame, path))
    monkeypatch.setattr(C, "LONGS", 1)
    C._longs.cache_clear()
    assert [C.long_pieces(u, path) for u in (long, long[1:], long)] == [len(C.tokenizer(path).encode(u, add_special_tokens=False)) for u in (long, long[1:], long)]
    assert len(C._longs(path)) == 1


def test_long_words_of_a_text_are_not_remembered():
    from shelfwave.llm.packing import LONG, WordIds

    path = P.path("word_bpe_49k.json")
    ids, library = WordIds(path), WordIds(path).library
    text = "short words " + " ".join("x" * LONG + str(k) for k in range(50)) + " Straße " + "ab-" * 90
    assert ids(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, [*ids.units, *ids.pieces, ""])) < LONG
    assert ids("short words") == np.array(library.encode("short words", add_special_tokens=False).ids, "<u4").tobytes() and "short" in ids.units


def test_a_worker_keeps_after_its_task_only_words_met_again(spark, monkeypatch):
    from shelfwave.llm import packing as K

    path = P.path("word_bpe_49k.json")
    ids, library = K.WordIds(path), K.WordIds(path).library
    texts = [f"Common common, w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}x own{k}" for k in range(100)]
    plain = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(map(ids, texts)) == plain
    ids.forget()
    assert set(ids.units) == {"Common", "common,"} and set(ids.pieces) <= set(ids.units)
    monkeypatch.setattr(K, "CACHE", 12)
    for t, want in zip(texts, plain, strict=True):
        assert ids(t) == want and max(len(ids.units), len(ids.pieces)) <= 12 + 8
    monkeypatch.undo()

    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert K.packed(rows, path).select("doc_id").distinct().count() == 100

    def left(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(K.word_ids(path).units)], pa.int64())], ["n"])

    assert max(r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(left, "n long").collect()) < 100
