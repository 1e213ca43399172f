"""Disguises whose plain part is an identifier of its own."""

import random
import re

import pytest

from tessera.llm import pii

TEXTS = {
    "jo" + "hn@example.com".replace("h", "\u04bb", 1): None,
    "j\u043ehn@example.com": None,
    "jo\u200bhn@example.com": None,
    "john dot doe@example.com": None,
    "john@example.c\u043em": None,
}


@pytest.mark.parametrize("text", list(TEXTS))
def test_added_span_extends_a_base_span(spark, text):
    base, every = pii.find_all(text)
    assert len(base) == 1 and base[0] in every
    assert ("email", 0, len(text)) in every and len(every) == 2
    got = pii.mask_personal_data(spark.createDataFrame([(1, f"to {text} now")], "doc_id long, text string")).first().text
    assert got == "to <email> now"


def test_covered_span_is_not_added():
    assert pii.find_all("a@b.c")[1] == [("email", 0, 5)]
    base, every = pii.find_all("mail a.b@c.de and x dot y")
    assert base == every == [("email", 5, 13)]


def test_plain_and_spaced_disguises():
    cases = {
        "write john at example.com now": ("email", 6, 25),
        "john @ example . com": ("email", 0, 20),
        "john &#64; example.com": ("email", 0, 22),
        "john&commat;example&period;com": ("email", 0, 30),
        "ip 1 9 2 dot 1 6 8 dot 1 dot 1 here": ("ip", 3, 30),
        "call +4 four 20 seven 946 zero 95 eight now": ("phone", 5, 39),
    }
    for text, span in cases.items():
        base, every = pii.find_all(text)
        assert span in every and set(base) <= set(every), (text, every)
    for text in ("look at example.com", "we met at noon. The dot", "see us at www.example.org", "version 1.2.3 and two of 4", "a @ b", "1 2 3 4 5 6 7 8 9 0"):
        assert pii.find_all(text)[1] == [], text


def test_digits_and_signs_against_brute_force():
    """Added card, phone and address spans are those of the written-out text, found by the base patterns."""
    r = random.Random(3)
    names = "zero one two three four five six seven eight nine".split()
    for _ in range(200):
        digits = [str(r.randrange(10)) for _ in range(15)]
        digits.append(next(str(d) for d in range(10) if pii._luhn("".join(digits) + str(d))))
        said = " ".join(names[int(d)] if r.random() < 0.5 else d for d in digits)
        if not any(w in said for w in names):
            continue
        text = f"card {said} end"
        assert ("card", 5, 5 + len(said)) in pii.find_all(text)[1], text
        number = digits[: r.randrange(8, 16)]
        said = "plus " + " ".join(names[int(d)] for d in number)
        assert ("phone", 4, 4 + len(said)) in pii.find_all(f"tel {said} .")[1]
        user, host = "".join(r.choice("abcxyz") for _ in range(5)), "".join(r.choice("abcxyz") for _ in range(4))
        said = user + r.choice([" at ", " (at) ", "[at]", " @ ", "&#64;", " {at} "]) + host + r.choice([" dot ", " (dot) ", "[dot]", " . ", "&#46;"]) + "com"
        assert ("email", 3, 3 + len(said)) in pii.find_all(f"to {said}, ok")[1], said


def test_cards_and_phones_against_brute_force():
    r = random.Random(5)
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(3000):
        t = "".join(r.choice("0123456789" * 3 + " -+().x") for _ in range(r.randrange(60)))
        digits = lambda x: "".join(c for c in x if c.isdigit())
        want = [("card", *m.span()) for m in card.finditer(t) if 16 <= len(digits(m[0])) <= 19 and pii._luhn(digits(m[0]))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 8 <= len(digits(m[0])) <= 15]
        assert [s for s in pii.find_base(t) if s[0] in ("card", "phone")] == want
