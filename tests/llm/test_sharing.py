"""Shared codes against plain counting; the last pass of near-duplicate detection on a crowd with one passage."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from shelfwave.llm import minhash as M, sharing as S
from shelfwave.llm.common import word_shingles


@pytest.mark.parametrize("slice_,frequent,narrow", [(S.SLICE, 3, False), (60, 3, False), (1, 0, True)])
def test_shared_codes_are_all_told(spark, monkeypatch, slice_, frequent, narrow):
    monkeypatch.setattr(S, "SLICE", slice_)
    r, parts = random.Random(slice_), 3
    code = lambda: (r.randrange(parts) << 32 | r.randrange(9)) if narrow else r.choice([-1, 1]) * r.randrange(12) * 10**17
    sets = {k: sorted({code() for _ in range(r.randrange(6))} | {r.randrange(parts) << 32 | 1000 + k}) for k in range(50)}
    rows = spark.createDataFrame([(k, -k, np.array(v, "<i8").tobytes()) for k, v in sets.items()], "key long, rid long, value binary").repartition(4)
    got = S.shared_codes(rows, lambda v: np.frombuffer(v, np.int64), parts, frequent, narrow)
    many = Counter(c for v in sets.values() for c in v)
    told: dict = {}
    for x in got.where("found is not null").collect():
        assert x["rid"] == -x["key"]
        told.setdefault(x["key"], []).extend(np.frombuffer(x["found"], "<i8").tolist())
    assert {k: sorted(v) for k, v in told.items()} == {k: s for k, v in sets.items() if (s := [c for c in v if many[c] > 1])}
    assert {x["code"]: x["rows"] for x in got.where("code is not null").collect()} == {c: n for c, n in many.items() if n > frequent}
    two = S.frequent_codes(got, 2)
    assert len(two) <= 2 and all(many[c] > frequent for c in two.tolist())


def crowd(n: int, near: int):
    """n texts that share one passage of about a third of each, and copies of `near` of them with one word changed."""
    r = random.Random(n)
    own = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    passage = own(60)
    texts = [own(60) + passage + own(40) for _ in range(n)]
    for k in range(near):
        t = list(texts[k])
        t[r.randrange(len(t))] = "changed"
        texts.append(t)
    return [(k, " ".join(t)) for k, t in enumerate(texts)], n


def test_a_crowd_with_one_passage_meets_only_its_near_copies(spark, tmp_path, monkeypatch):
    rows, n = crowd(700, 60)
    met = []
    meeting = M._meeting
    monkeypatch.setattr(M, "_meeting", lambda *a: met.append(meeting(*a)) or met[-1])
    monkeypatch.setattr(M, "FREQUENT", 100)
    path = str(tmp_path / "crowd")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    # single values as bands: all 760 share some bucket, so every pair is left to the last pass
    got = {x["doc_id"]: x["component_id"] for x in M.near_duplicates(spark.read.parquet(path), M.Banding(permutations=40, rows=1)).collect()}
    assert got == {k: k if k < n else k - n for k, _ in rows}
    assert len(met) == 1 and met[0].count() <= 60  # of 288,000 pairs


def test_no_alike_pair_is_lost_by_prefixes(spark):
    r = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[a:a + r.randrange(20, 60)] + [f"x{r.randrange(50)}" for _ in range(r.randrange(6))]) for a in (r.randrange(0, 300, 3) for _ in range(220))]
    sets = [word_shingles(t, 3) for t in texts]
    frame = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "id long, set binary")
    members = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "id long, n long")
    groups = spark.createDataFrame([(k, k % 7) for k in range(220)], "node long, component long")
    for percent in (80, 50):
        begin = M._prefixes(members, frame, percent)
        got = {(x["a"], x["b"]) for x in M._meeting(begin, groups, percent).collect()}
        both = {(a, b): len(np.intersect1d(sets[a], sets[b])) for a in range(220) for b in range(a) if a % 7 != b % 7}
        alike = {(a, b) for (a, b), n in both.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)}
        assert alike and alike <= got and len(got) < len(both) / (10 if percent == 80 else 4)


def test_a_pair_meets_at_its_first_common_shingle_only(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = [" ".join([*base, *(f"x{r.randrange(10**6)}" for _ in range(3))]) for _ in range(30)]
    sets = [word_shingles(t, 3) for t in texts]
    frame = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "id long, set binary")
    members = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "id long, n long")
    begin = M._prefixes(members, frame, 80)
    assert begin.count() > 10 * len(sets)  # each pair has many shingles of its prefixes in common
    monkeypatch.setattr(type(begin), "distinct", lambda self: self)
    assert M._meeting(begin, spark.createDataFrame([], "node long, component long"), 80).count() == 30 * 29 // 2


def test_rows_that_tell_shared_shingles_do_not_grow_with_the_tasks(spark, monkeypatch):
    r = random.Random(6)
    base = [f"w{k}" for k in range(150)]
    sets = [word_shingles(" ".join([*base, f"x{r.randrange(10**6)}", f"y{k}"]), 3) for k in range(40)]
    frame = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "id long, set binary").repartition(40)
    members = spark.createDataFrame([(k, len(s)) for k, s in enumerate(sets)], "id long, n long")
    told = []
    shared = M.shared_codes
    monkeypatch.setattr(M, "shared_codes", lambda *a: told.append(shared(*a)) or told[-1])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        begins = []
        for tasks in ("2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            begins.append(sorted((x["id"], x["at"], x["shingle"]) for x in M._prefixes(members, frame, 80).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert begins[0] == begins[1] and begins[0]
    assert all(t.where("found is not null").count() <= len(sets) * M.PARTS for t in told)  # not one for each of 148 shingles


def test_what_was_moved_for_shared_codes_is_removed(spark, tmp_path):
    import gc
    import re
    import time

    path = str(tmp_path / "codes")
    spark.range(200).selectExpr("id as key", "-id as rid", "unhex(lpad(hex(id % 9), 16, '0')) as value").write.parquet(path)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in re.findall(r"shuffle_\w+", disk.getAllFiles().mkString(" "))}  # noqa: E731  one list, as files go meanwhile
    gc.collect()
    gc.disable()  # whether Python collects its garbage meanwhile is left to chance otherwise
    try:
        before = files()
        found = S.shared_codes(spark.read.parquet(path), lambda v: np.frombuffer(v, ">i8").astype(np.int64), 4, 3)
        for _ in range(20):
            if not files() - before:
                break
            time.sleep(0.5)
        assert not files() - before and found.count() > 0
    finally:
        gc.enable()
