"""Long and spelled-out addresses: the network sees all of them, and finds them whole."""

from __future__ import annotations

import random

import pytest

LONG = "firstname.lastname.department [@] mail.company.example.com"
SPELLED = ["anna at host dot com", "jo.b (at) mail (dot) host (dot) org", "first dot last at mail dot company dot example dot com", "name [at] host.example.com"]


def test_stretches_hold_whole_addresses():
    from shelfwave.llm.pii import plausible, stretches

    for form in [LONG, "firstname . lastname . department @ mail . company . example . com", "x" * 300 + "(@)" + "y" * 300 + ".org", *SPELLED]:
        text = "and of the other words before it " + form + " in that and more of it after"
        at = text.index(form)
        assert any(a <= at and at + len(form) <= b for a, b in stretches(text)), form
        assert plausible(form, "email")
    assert not list(stretches("look at that. She was at home and said so")) and not plausible("look at that", "email")


def test_pieces_do_not_cut_long_forms():
    from shelfwave.llm.pii import WINDOW, pieces

    text = " ".join(str(k) for k in range(3000))
    for a, b, low, high in pieces(text):
        assert b == len(text) or high + WINDOW <= b
        assert a == 0 or low - WINDOW >= a


def test_an_address_is_taken_to_its_ends():
    from shelfwave.llm.pii import addresses, whole_address

    for text, part, whole in [("to ann-b.c(at)uh.org now", "b.c(at)uh", "ann-b.c(at)uh.org"), ("see a (at) b (dot) co (dot) uk, ok", "a (at) b (dot", "a (at) b (dot) co (dot) uk"), ("(a@b.com) then", "a@b.com", "a@b.com")]:
        at = text.index(part)
        a, b = whole_address(text, at, at + len(part))
        assert text[a:b] == whole
    text = "mail jo(@)host.org or al at b dot com"
    assert [text[a:b] for a, b in addresses(text, 0, len(text))] == ["jo(@)host.org", "al at b dot com"]


@pytest.fixture(scope="module")
def tagger():
    from shelfwave.llm.charcrf import Tagger
    from shelfwave.llm.pii import KINDS, training_rows

    out = Tagger(len(KINDS))
    out.train(*training_rows([(t, "0" * len(t)) for t in ["write to them and call today", "nothing here", "the server is down"]]))
    return out


def test_long_and_spelled_forms_are_found_whole(tagger):
    from shelfwave.llm.pii import found_spans

    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghijklmnoprstuvw", k=r.randrange(3, 9)))
    lead = lambda: " ".join(r.choices("and of the write to or for is my words".split(), k=r.randrange(1, 8))) + " "
    kinds = [lambda: f"{word()} at {word()} dot com", lambda: f"{word()} (at) {word()} (dot) co (dot) uk", lambda: f"{word()}.{word()}.{word()} [@] {word()}.{word()}.example.com"]
    for make in kinds:
        held = 0
        for _ in range(50):
            before, form = lead(), make()
            spans = found_spans([before + form + " in that"], tagger)[0]
            held += any(a <= len(before) and len(before) + len(form) <= b <= len(before) + len(form) + 1 and kind == "email" for a, b, kind in spans)
        assert held >= 43, make()
    assert found_spans(["she was at home. Then at noon they met"], tagger) == [[]]
