"""Personal data: rules for plain forms, and a character-level BiLSTM-CRF, trained here from labelled spans, for forms that the rules miss.

Every span has a digit, an "@" or a spelled-out "at" with a dot after it (decoding allows no other), so the network needs to see only the surroundings
of those: all of them, up to the ends of the tokens there and of what dots join to them, in overlapping windows. Scores of overlapping windows are
blended and each stretch is decoded once, as a whole."""

from __future__ import annotations

import hashlib
import heapq
import json
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwave.llm.charcrf import PAD, Tagger, codes_of
from shelfwave.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # a match can only start where a run of digits does
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")
ANCHORS = re.compile(r"[0-9@](?:[^0-9@]{0,15}[0-9@])*")
_AT, _DOT = "(?:at|ät|arobase|arroba)", "(?:dot|punkt|point|punto)"
AT = rf"(?:\s{{0,3}}[\[({{<]\s?{_AT}\s?[\])}}>]\s{{0,3}}|\s{{1,3}}{_AT}\s{{1,3}})"
DOT = rf"(?:\s{{0,3}}[\[({{<]\s?(?:{_DOT}|\.)\s?[\])}}>]\s{{0,3}}|\s{{1,3}}{_DOT}\s{{1,3}}|\.(?=\S)|\s\.\s)"
SPELLED = re.compile(rf"(?<=[\w%+-]){AT}(?=[A-Za-z0-9-]{{1,63}}{DOT}[A-Za-z0-9])", re.IGNORECASE)  # an "at" between a name and a host
_BRACKETED = rf"\s{{0,3}}[\[({{<]\s?{_DOT}\s?[\])}}>]\s{{0,3}}"
REST = re.compile(rf"[A-Za-z0-9-]*(?:(?:\.|{_BRACKETED})[A-Za-z0-9-]+)*", re.IGNORECASE)
SIGN = re.compile(r"\s{0,3}[\[({<]?\s?@")
NAME = re.compile(rf"[A-Za-z0-9_%+-]+(?:(?:\.+|{DOT})[A-Za-z0-9_%+-]+)*\.*$", re.IGNORECASE)
HOST = re.compile(rf"\s?[\])}}>]?\s{{0,3}}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
OPEN_DOT = re.compile(rf"[\[({{<]\s?{_DOT}?$", re.IGNORECASE)  # a span that ends within a bracketed dot
TOKEN = re.compile(r"\S+")
BINDS = re.compile(rf"[\[({{<]?(?:{_AT}|{_DOT}|[@.])[\])}}>]?|[\[({{<]|[\])}}>]", re.IGNORECASE)  # tokens that join those at their sides
WINDOW, STRIDE, AROUND, LONGEST = 128, 64, 20, 2048

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of EMAIL from left to right, found from the "@" outwards, as scanning every word for one takes too long."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found.start(), found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start, then kind as listed; ends are exclusive."""
    if not ANCHOR.search(text):
        return []
    found = [(a, b, "email") for a, b in _emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _starts_at(text: str, a: int, least: int) -> int:
    """Where the token at `a` and those bound to it begin, but not before `least`."""
    end = a
    while end < len(text) and end - a < 12 and not text[end].isspace():
        end += 1
    while True:
        while a > least and not text[a - 1].isspace():
            a -= 1
        e = a
        while e > least and a - e < 3 and text[e - 1].isspace():
            e -= 1
        k = e
        while k > least and not text[k - 1].isspace():
            k -= 1
        if k == e or e == a or not (BINDS.fullmatch(text, a, end) or BINDS.fullmatch(text, k, e)):
            return a
        a, end = k, e


def _ends_at(text: str, b: int) -> int:
    """Where the token at `b` and those bound to it end."""
    start = b
    while start > 0 and b - start < 12 and not text[start - 1].isspace():
        start -= 1
    while True:
        while b < len(text) and not text[b].isspace():
            b += 1
        m = TOKEN.search(text, b, b + 64)
        if not m or m.start() > b + 3 or not (BINDS.fullmatch(text, start, b) or BINDS.fullmatch(text, *m.span())):
            return b
        start, b = m.start(), m.end()


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every digit, "@" and spelled-out "at" with their surroundings to the ends of the tokens; overlapping ones are one."""
    start = end = None
    for x, y in heapq.merge((m.span() for m in ANCHORS.finditer(text)), (m.span() for m in SPELLED.finditer(text))):
        if end is not None and y + AROUND <= end:
            continue
        a = _starts_at(text, max(0, x - AROUND), end or 0) if end is None or x - AROUND > end else end
        b = _ends_at(text, min(len(text), y + AROUND))
        if end is not None and a <= end:
            end = max(end, b)
            continue
        if end is not None:
            yield start, end
        start, end = a, b
    if end is not None:
        yield start, end


def pieces(text: str) -> Iterator[tuple[int, int, int, int]]:
    """(start, end, from, to): stretches in pieces of bounded length; spans that begin in [from, to) count, so that each counts once."""
    for a, b in stretches(text):
        at = a
        while b - at > LONGEST:
            yield at, at + LONGEST, at if at == a else at + WINDOW, at + LONGEST - WINDOW
            at += LONGEST - 2 * WINDOW
        yield at, b, at if at == a else at + WINDOW, b


def tags_of(spans: list[Span], start: int, end: int) -> np.ndarray:
    y = np.zeros(end - start, np.int8)
    for a, b, kind in spans:
        if a >= start and b <= end:
            k = KINDS.index(kind)
            y[a - start] = 2 * k + 1
            y[a - start + 1:b - start] = 2 * k + 2
    return y


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, k = [], 0
    while k < len(tags):
        if tags[k] % 2:
            e = k + 1
            while e < len(tags) and tags[e] == tags[k] + 1:
                e += 1
            out.append((k, e, tags[k] // 2))
            k = e
        else:
            k += 1
    return out


_NUMBERS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}


def plausible(text: str, kind: str) -> bool:
    digits = sum("0" <= c <= "9" for c in text)
    if kind == "email":
        return "@" in text[1:-1] and text[0] != "@" != text[-1] or SPELLED.search(text) is not None
    low, high = _NUMBERS[kind]
    if not low <= digits <= high or any(c.isalpha() for c in text):
        return False
    if kind == "card":
        return luhn("".join(c for c in text if "0" <= c <= "9"))
    numbers = re.findall("[0-9]+", text)
    return kind != "ip" or len(numbers) == 4 and all(int(n) <= 255 for n in numbers)


def whole_address(text: str, a: int, b: int) -> tuple[int, int]:
    """An email's span from the start of its name, which no dot joins to the word before, to the end of the host it ends in."""
    while a > 0 and text[a] in _LOCAL and text[a - 1] in _LOCAL:
        a -= 1
    sign = min(filter(None, (SPELLED.search(text, a + 1, b), SIGN.search(text, a + 1, b))), key=lambda m: m.start(), default=None)
    name = sign and NAME.search(text[a:sign.start()])
    host = sign and HOST.match(text, sign.end(), b)
    if host and host.end() < b and not OPEN_DOT.search(text, a, b) and not text[host.end()].isalnum():
        b = host.end()
    a += name.start() if name else 0
    cut = OPEN_DOT.search(text, a, b)
    return a, REST.match(text, cut.start() if cut and re.compile(_BRACKETED, re.IGNORECASE).match(text, cut.start()) else b).end()


def addresses(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The addresses of an email's span, which may run over several."""
    while a < b and plausible(text[a:b], "email"):
        start, end = whole_address(text, a, b)
        yield start, end
        a = max(end, a + 1)


def found_spans(texts: list[str], tagger: Tagger, group: int = 512) -> list[list[Span]]:
    """Spans of the network for each text, without those of the rules."""
    jobs = [(k, *p) for k, t in enumerate(texts) for p in pieces(t)]
    out: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(jobs), group):
        part = sorted(jobs[at:at + group], key=lambda j: j[2] - j[1])
        if not part:
            continue
        codes = {j: codes_of(texts[j[0]][j[1]:j[2]]) for j in part}
        windows, places = [], []
        for n, j in enumerate(part):
            c = codes[j]
            for s in range(0, max(1, len(c) - WINDOW + STRIDE), STRIDE):
                w = np.full(WINDOW, PAD, np.int16)
                w[:len(c[s:s + WINDOW])] = c[s:s + WINDOW]
                windows.append(w)
                places.append((n, s))
        ramp = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float64)[:, None]
        sums: list[np.ndarray] = [np.zeros((len(codes[j]), tagger.tags + 1)) for j in part]
        for w in range(0, len(windows), group):
            scores = tagger.emissions(np.stack(windows[w:w + group]))
            for e, (n, s) in zip(scores, places[w:w + group], strict=True):
                have = len(sums[n][s:s + WINDOW])
                sums[n][s:s + have, :-1] += e[:have] * ramp[:have]
                sums[n][s:s + have, -1:] += ramp[:have]
        for low in range(0, len(part), 64):  # of similar length
            some = part[low:low + 64]
            longest = max(len(codes[j]) for j in some)
            e = np.zeros((len(some), longest, tagger.tags))
            for n, j in enumerate(some):
                s = sums[low + n]
                e[n, :len(s)] = s[:, :-1] / s[:, -1:]
            tags = tagger.best_tags(e, np.array([len(codes[j]) for j in some]))
            for (k, a, b, lo, hi), row in zip(some, tags, strict=True):
                for s, t, kind in spans_of(row[:b - a]):
                    if lo <= a + s < hi and plausible(texts[k][a + s:a + t], KINDS[kind]):
                        places = addresses(texts[k], a + s, a + t) if KINDS[kind] == "email" else [(a + s, a + t)]
                        out[k].extend((x, y, KINDS[kind]) for x, y in places)
    return out


def all_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """(spans of the rules, all spans) of each text. A span of the network that meets one of the rules or an earlier one gives way."""
    out = []
    for t, found in zip(texts, found_spans(texts, tagger), strict=True):
        base = base_spans(t)
        taken = sorted((a, b) for a, b, _ in base)
        more, last = [], 0
        for a, b, kind in sorted(found):
            if a >= last and not any(x < b and a < y for x, y in taken):
                more.append((a, b, kind))
                last = b
        out.append((base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


# --- training --------------------------------------------------------------------------------------------------------------------------

SAMPLE = 1500  # most windows of the corpus that labels are taken from
MADE = 3000  # windows with made-up forms


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choices("0123456789", k=n))


def made_form(r: random.Random) -> tuple[str, str | None]:
    """A made-up form and its kind, or None: forms the rules know, forms they miss, and look-alikes that are no personal data."""
    name = "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randrange(3, 9))) + r.choice(["", ".", "_", "-"]) * r.randrange(2) + r.choice(["", _digits(r, 2)])
    name = name.strip("._-") or "me"
    host = "".join(r.choices("abcdefghilmnoprstu", k=r.randrange(3, 8))) + r.choice(["", _digits(r, 1)]) + "." + r.choice(["com", "org", "net", "example.com", "co.uk", "de"])
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randrange(3, 11)))
    long = r.choice("._-").join(word() for _ in range(r.randrange(2, 5)))
    domain = ".".join(word() for _ in range(r.randrange(1, 4))) + "." + r.choice(["com", "org", "net", "example.com", "co.uk", "de"])
    at = r.choice([" at ", " at ", "(at)", "[at]", " (at) ", " [at] ", " AT "])
    dot = r.choice([" dot ", " dot ", "(dot)", "[dot]", " (dot) ", " [dot] ", " DOT "])
    whose = r.choice([name, name, long])
    spelled = r.choice([whose, whose.replace(".", dot)]) + at + r.choice([host, host, domain]).replace(".", dot)
    bare = f"{whose} at {r.choice([host, domain]).replace('.', ' dot ')}"
    part = lambda: str(r.randrange(1, 256))
    d = lambda n: _digits(r, n)
    card = r.choice("3456") + d(14)
    card += next(c for c in "0123456789" if luhn(card + c))
    four = [card[k:k + 4] for k in range(0, 16, 4)]
    forms = [
        (f"{name}@{host}", "email"), (f"{name} @ {host}", "email"), (f"{name}(@){host}", "email"), (f"{name}[@]{host}", "email"),
        (f"{long}@{domain}", "email"), (f"{long}{r.choice([' @ ', ' (@) ', ' [@] ', '(@)', '[@]'])}{domain}", "email"), (spelled, "email"), (spelled, "email"), (bare, "email"), (bare, "email"), (bare, "email"), (f"{r.choice([name, long])}{r.choice(['(at)', '[at]', ' (at) ', ' [at] '])}{r.choice([host, domain])}", "email"),
        (f"at {word()} {word()}", None), (f"at {word()}. {word().capitalize()}", None), (f"{word()} @{name}", None),
        (".".join(part() for _ in range(4)), "ip"), ("[.]".join(part() for _ in range(4)), "ip"), (" . ".join(part() for _ in range(4)), "ip"),
        (card, "card"), (" ".join(four), "card"), ("-".join(four), "card"), (".".join(four), "card"), ("/".join(four), "card"),
        (f"+{r.randrange(1, 99)} ({d(3)}) {d(3)}-{d(4)}", "phone"), (f"+{r.randrange(1, 99)} {d(3)} {d(3)} {d(4)}", "phone"), (f"({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}-{d(3)}-{d(4)}", "phone"), (f"00{d(2)} {d(3)} {d(3)} {d(3)}", "phone"),
        (f"{r.randrange(1990, 2040)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", None), (f"{r.randrange(24)}:{r.randrange(60):02}", None), (f"{r.randrange(1, 999)},{d(3)}.{d(2)}", None), (f"{r.randrange(9)}.{r.randrange(20)}", None),
        (f"version {r.randrange(9)}.{r.randrange(20)}.{r.randrange(9)}", None), (f'token = "{"".join(r.choices("0123456789abcdef", k=40))}"', None), (f"password={''.join(r.choices('0123456789abcdef', k=18))}", None),
        ("AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)), None), (f"#{d(r.randrange(3, 10))}", None), (d(r.randrange(1, 8)), None), (f"{d(2)}%", None), (f"@{name}", None), (f"{d(1)}/{d(2)}", None),
    ]
    return r.choice(forms)


def labelled_windows(docs: DataFrame, most: int, text: str) -> list[tuple[str, str]]:
    """At most `most` windows around digits and "@" with the rules' tags, those of least hash over all documents. Windows with a run of digits that could
    be a card but fails its check are left out, as no rule says what they are."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                if not ANCHOR.search(t):
                    continue
                spans = base_spans(t)
                for a, b in stretches(t):
                    b = min(b, a + WINDOW)
                    if any((x < a < y) or (x < b < y) for x, y, _ in spans):
                        continue
                    if SPELLED.search(t, max(0, a - WINDOW), b):  # the rules do not know these
                        continue
                    y = tags_of(spans, a, b)
                    if any(len(m[0]) >= 12 and not y[m.start()] for m in CARD.finditer(t[a:b])):
                        continue
                    rows.append((int.from_bytes(hashlib.blake2b(t[a:b].encode(), digest_size=8).digest(), "big", signed=True), t[a:b], "".join(map(str, y))))
            rows = sorted(set(rows))[:most]  # a batch has no more to give
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["h", "window", "tags"])

    got = docs.select(F.col(f"`{text}`")).where(F.col(f"`{text}`").rlike("[0-9@]")).mapInArrow(cut, "h bigint, window string, tags string").distinct().orderBy("h", "window", "tags").limit(most).collect()
    return [(r["window"], r["tags"]) for r in got]


def training_rows(real: list[tuple[str, str]], made: int = MADE, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags: the corpus's own, and made-up forms set between words of the same windows."""
    r = random.Random(seed)
    words = [w for t, _ in real for w in re.findall(r"[^\W\d_]{1,14}[.,]?", t)]
    # few windows hold few words, so made-up ones join them
    words += ["".join(r.choices("eeeaaiioonnttrrssldhcumpgéü", k=r.randrange(1, 10))) + r.choice(["", "", "", ".", ","]) for _ in range(max(500, len(words) // 4))]
    rows = list(real)
    for _ in range(made):
        form, kind = made_form(r)
        left, right = (" ".join(r.choices(words, k=r.randrange(0, 5))) for _ in range(2))
        left, right = left[-AROUND:], right[:AROUND]
        before = left + (r.choice([" ", " ", " ", "\n", ": ", "("]) if left else "")
        after = (r.choice([" ", " ", ", ", ". ", "\n", ")"]) if right else "") + right
        t = (before + form + after)[:WINDOW]
        if len(before) + len(form) > WINDOW:
            continue
        rows.append((t, "".join(map(str, tags_of([(len(before), len(before) + len(form), kind)] if kind else [], 0, len(t))))))
    x, y = np.full((len(rows), WINDOW), PAD, np.int16), np.zeros((len(rows), WINDOW), np.int8)
    for k, (t, tags) in enumerate(rows):
        x[k, :len(t)], y[k, :len(t)] = codes_of(t), [int(c) for c in tags]
    return x, y


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE, made: int = MADE, epochs: int = 7) -> Tagger:
    """A tagger from the rules' spans in at most `sample` windows of `docs` and `made` made-up ones; an empty table leaves the latter. It is fitted in
    one task, as the rows are bounded, and comes back with its parameters (some thousand numbers)."""
    rows = docs.sparkSession.createDataFrame([(json.dumps(labelled_windows(docs, sample, text)),)], "rows string").coalesce(1)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for given in batch.column(0).to_pylist():
                tagger = Tagger(len(KINDS))
                tagger.train(*training_rows([tuple(r) for r in json.loads(given)], made), epochs=epochs)
                yield pa.RecordBatch.from_arrays([pa.array(list(tagger.p)), pa.array([v.astype("<f4").tobytes() for v in tagger.p.values()], pa.binary())], ["name", "value"])

    tagger = Tagger(len(KINDS))
    for r in rows.mapInArrow(fit, "name string, value binary").collect():
        tagger.p[r["name"]] = np.frombuffer(r["value"], "<f4").reshape(tagger.p[r["name"]].shape).copy()
    return tagger


def personal_data(docs: DataFrame, tagger: Tagger, text: str = "text", keep=None) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone and base_sha256 (spans of the rules), spans (all, the network's too) and n_added to every row, from its
    whole text. Positions are code points. Null or empty text: none. Repeated rows get equal spans. One pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def find(texts: list[str]) -> dict:
        out: dict[str, list] = {n: [] for n in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for base, every in all_spans(texts, shared.value):
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            digest, joined = (",".join(f"{k}:{a}:{b}" for a, b, k in spans) for spans in (base, every))
            out["base_sha256"].append(hashlib.sha256(digest.encode()).hexdigest())
            out["spans"].append(joined)
            out["n_added"].append(len(every) - len(base))
        return out

    return map_texts(docs, find, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", text, keep)


def masked(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """All columns, with every span of the text replaced by its kind in angle brackets. A text without one is unchanged, null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def mask(texts: list[str]) -> dict:
        out = []
        for t, (_, spans) in zip(texts, all_spans(texts, shared.value), strict=True):
            done, end = [], 0
            for a, b, kind in spans:
                if b > end:  # spans of two kinds may overlap; what is left of the later one goes with it
                    done += [t[end:a], f"<{kind}>"] if a >= end else []
                    end = b
            out.append("".join([*done, t[end:]]))
        return {"__masked": out}

    return map_texts(docs, mask, "__masked string", text).withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.col("__masked"))).drop("__masked")
