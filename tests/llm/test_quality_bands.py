"""Default limits of the compression bands on clean, repeated and mixed texts."""

from __future__ import annotations

import random
from itertools import accumulate

from shelfwave.llm.quality import Bands, judge


def prose(n_bytes, seed=1, own=1500, stem=2):
    """Clean text whose words come as often as in ordinary language, and which says its terms again."""
    r = random.Random(seed)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve"]
    words = ["".join(r.choices(parts, k=r.randrange(1, stem + 2))) for _ in range(own)]
    weights = list(accumulate(1 / (k + 3) for k in range(own)))
    out, size = [], 0
    while size < n_bytes:
        line = " ".join(r.choices(words, cum_weights=weights, k=r.randrange(6, 16))).capitalize() + ". "
        out.append(line)
        size += len(line)
    return "".join(out)[:n_bytes]


def kept(*texts):
    return judge(list(texts), Bands())["kept"]


def test_clean_texts_are_kept_up_to_several_megabytes():
    sizes = [1 << k for k in range(10, 23)] + [700 << 10]
    got = judge([prose(n, own=12000, stem=3) for n in sizes], Bands())
    ratios = got["ratio"].to_pylist()
    assert max(ratios) > 2.76  # over the limit that once held from 32 KB on
    assert all(got["kept"]), list(zip(sizes, ratios, strict=True))
    wordy = [prose(n, own=700) for n in (12000, 17000, 35000)]  # a licence's wording: some 2.6 to 3.0
    assert kept(*wordy) == [True] * 3


def test_limits_rise_with_length_and_symbols_get_no_room():
    limits = [Bands().limits(1 << k)[1] for k in range(9, 30)]
    assert all(b > a for a, b in zip(limits, limits[1:]))
    assert Bands().limits(1 << 14, 1 << 13)[1] < Bands().limits(1 << 14)[1]


def test_repeated_texts_are_rejected_at_every_length():
    for n in (2000, 20000, 200000):
        once = prose(n)
        assert kept(once, once + once[:n * 9 // 10] + once) == [True, False]
    line = "the same long line over and over again with a number\n"
    assert kept("".join(f"{k} {line}" for k in range(6000))) == [False]


def test_half_a_text_of_noise_is_rejected_wherever_it_lies():
    r = random.Random(7)
    noise = "".join(chr(r.randrange(33, 127)) for _ in range(40000))
    for n in (600, 1500, 4095, 4096, 8191, 30000):
        clean, half = prose(n, seed=4), n // 2
        bad = noise[:half]
        mixed = [clean[:half] + bad, bad + clean[:half], clean[:half // 2] + bad + clean[half // 2:half], clean]
        assert kept(*mixed) == [False, False, False, True], n
    assert kept(prose(4096) + noise[:4095], noise[:4095] + prose(4096), prose(4096) + noise[:300]) == [False, False, True]


def test_every_byte_is_in_one_chunk_of_each_cut():
    for n in (0, 1, 255, 511, 512, 4095, 4096, 4097, 8191, 32767, 32768, 100001):
        for ends in Bands().cuts(n):
            assert ends[-1] == n and (n == 0 or all(a < b <= a + 4096 for a, b in zip([0, *ends], ends)))
