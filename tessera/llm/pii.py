"""Personal data, with offset-preserving deobfuscation.

Base identifiers are found in the text as it stands.  Then transducers rewrite the text
where a trigger says it may hide more: look-alike letters and digits become ASCII and
invisible characters go, spelled digits (among others or not) become digits, character
references and written-out or spaced at and dot become signs.  Every character of the rewritten text carries the source span it came from, so a
find there is mapped back to source characters.  Only finds that contain a rewritten
character and that no base span of their kind covers are added, beside base spans that
they extend.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@label(.label)+, from one sign to the next: the local part is the run before the sign."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at)):
            out.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


# Letters of other scripts that look like ASCII ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-",
}
# Characters without a glyph.
_INVISIBLE = frozenset("­​‌‍‎‏⁠⁡⁢⁣⁤﻿")
# Digit words by value, in English, German, French and Spanish.
_DIGIT_WORDS = [
    ["zero", "oh", "null", "zéro", "cero"],
    ["one", "eins", "un", "uno"],
    ["two", "zwei", "deux", "dos"],
    ["three", "drei", "trois", "tres"],
    ["four", "vier", "quatre", "cuatro"],
    ["five", "fünf", "cinq", "cinco"],
    ["six", "sechs", "seis"],
    ["seven", "sieben", "sept", "siete"],
    ["eight", "acht", "huit", "ocho"],
    ["nine", "neun", "neuf", "nueve"],
]
_VALUE = {w: str(d) for d, words in enumerate(_DIGIT_WORDS) for w in words}
_WORD = "(?:" + "|".join(sorted(_VALUE, key=len, reverse=True)) + ")"
_POINT = r"(?:dot|point|punkt|punto)"
_OPEN, _CLOSE = r"[(\[{<]", r"[)\]}>]"
_ODD = re.compile("[^\x00-ɏ]|­")
_DIGIT = rf"(?:{_WORD}|[0-9]+)"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[\s-]+|\+\s?)?{_DIGIT}(?:[\s,.-]{{1,3}}(?:{_POINT}[\s-]+)?{_DIGIT}){{3,}}+(?!\w)", re.I)
_SPELLED_PART = re.compile(rf"(plus|\+)|({_WORD})(?!\w)|({_POINT}|(?<=[0-9])\.(?=[0-9]))|([0-9])", re.I)
_LETTER = re.compile(r"[^\W\d_]")
# Words before a bare "at" that is no sign.
_NO_LOCAL = "a|an|and|are|available|be|been|but|by|call|check|done|find|found|go|he|here|him|her|home|hosted|how|i|in|info|is|it|live|located|look|looked|looking|me|meet|more|not|now|of|on|or|out|read|see|seen|she|sold|stay|that|the|them|then|there|these|they|this|those|to|up|us|visit|was|we|were|what|when|where|which|who|work|working|works|you"
_ENTITY = re.compile(r"&(?:#0*(?:64|46)|#x0*(?:40|2e)|commat|period);", re.I)
_LABELS = r"[A-Za-z0-9-]+(?:(?:\.|\s{1,2}\.\s{1,2})[A-Za-z0-9-]+)*(?:\.|\s{1,2}\.\s{1,2})[A-Za-z]{2,}"
_PROSE = re.compile(rf"(?<![\w.%+-])(?:{_NO_LOCAL})\Z", re.I)
_SPACED_AT = re.compile(rf"(?<=[A-Za-z0-9])(?:\s+@\s*|\s*@\s+)(?=[A-Za-z0-9-]+\s{{0,2}}\.\s{{0,2}}[A-Za-z0-9])")
_PLAIN_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+(?={_LABELS}(?![\w-]))", re.I)
_SPACED_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:(?:\s{1,2}\.\s{0,2}|\.)[A-Za-z0-9-]+)*?\s{1,2}\.\s{1,2}[A-Za-z]{2,}(?![A-Za-z0-9-])")
_SPACED_DOT = re.compile(r"\s+\.\s*|\.\s+")
_MARKED_AT = re.compile(rf"\s*{_OPEN}\s*(?:at|@|arroba|arobase)\s*{_CLOSE}\s*", re.I)
_MARKED_DOT = re.compile(rf"\s*{_OPEN}\s*(?:{_POINT}|\.)\s*{_CLOSE}\s*", re.I)
_BARE_AT = re.compile(rf"(?<=[A-Za-z0-9])\s+at\s+(?=[A-Za-z0-9-]+(?:\s+{_POINT}\s+|\s*{_OPEN}\s*(?:{_POINT}|\.)\s*{_CLOSE}\s*)[A-Za-z])", re.I)
_BARE_DOT = re.compile(rf"(?<=[A-Za-z0-9])\s+{_POINT}\s+(?=[A-Za-z0-9])", re.I)
_TRIGGER = re.compile(rf"{_ENTITY.pattern}|\s@|@\s|\sat\s+[a-z0-9-]+\s{{0,2}}\.|[0-9][\s,.-]{{1,3}}{_WORD}(?!\w)|(?<!\w){_WORD}[\s,.-]{{1,3}}[0-9]|{_OPEN}\s*(?:at|@|arroba|arobase|{_POINT}|\.)\s*{_CLOSE}|\s{_POINT}\s|(?<!\w){_WORD}[\s,.-]{{1,3}}{_WORD}[\s,.-]{{1,3}}{_WORD}(?!\w)", re.I)


class Rewritten:
    """A text under rewriting: ``text`` and per character the source span and whether it changed."""

    def __init__(self, source: str):
        self.text = source
        self.start = list(range(len(source)))
        self.end = list(range(1, len(source) + 1))
        self.new = bytearray(len(source))

    def splice(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Replace [a, b) by characters that stem from [c, d) of the present text; edits in order, disjoint."""
        if not edits:
            return
        text, start, end, new, at = [], [], [], bytearray(), 0
        for a, b, chars in edits:
            text.append(self.text[at:a])
            start += self.start[at:a]
            end += self.end[at:a]
            new += self.new[at:a]
            for c, x, y in chars:
                text.append(c)
                start.append(self.start[x])
                end.append(self.end[y - 1])
                new.append(1)
            at = b
        text.append(self.text[at:])
        self.start, self.end, self.new = start + self.start[at:], end + self.end[at:], new + self.new[at:]
        self.text = "".join(text)


def _plain(c: str) -> str:
    """The ASCII character that ``c`` looks like or is a form of, else ``c``."""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    form = unicodedata.normalize("NFKC", c)
    if len(form) == 1 and form.isascii():
        return form
    value = unicodedata.digit(c, None)
    return c if value is None else str(value)


def rewrite(text: str) -> Rewritten | None:
    """The deobfuscated text; None where nothing triggers."""
    odd = _ODD.search(text) is not None
    if not odd and not _TRIGGER.search(text):
        return None
    out = Rewritten(text)
    if odd:
        edits = []
        for i, c in enumerate(text):
            if c in _INVISIBLE:
                edits.append((i, i + 1, []))
            elif c > "ɏ" and (p := _plain(c)) != c:
                edits.append((i, i + 1, [(p, i, i + 1)]))
        out.splice(edits)
        for k in range(1, len(out.text)):
            if out.start[k] != out.end[k - 1]:  # something invisible went from here
                out.new[k - 1] = out.new[k] = 1
    out.splice([(*m.span(), [("@" if m[0].strip("&#;").lower().lstrip("0x") in ("64", "40", "commat") else ".", *m.span())]) for m in _ENTITY.finditer(out.text)])
    edits = []
    for m in _SPELLED.finditer(out.text):
        if _LETTER.search(m[0]):  # digits alone are left as they stand
            kinds = ((p, "+" if p[1] else _VALUE[p[2].lower()] if p[2] else "." if p[3] else p[4]) for p in _SPELLED_PART.finditer(out.text, m.start(), m.end()))
            edits.append((m.start(), m.end(), [(c, *p.span()) for p, c in kinds]))
    out.splice(edits)
    for pattern, sign in ((_MARKED_AT, "@"), (_BARE_AT, "@"), (_MARKED_DOT, "."), (_BARE_DOT, "."), (_SPACED_AT, "@")):
        out.splice([(*m.span(), [(sign, *m.span())]) for m in pattern.finditer(out.text)])
    out.splice([(*m.span(), [("@", *m.span())]) for m in _PLAIN_AT.finditer(out.text) if not _PROSE.search(out.text, max(0, m.start() - 12), m.start())])
    dots = [(m.start() + d.start(), m.start() + d.end()) for m in _SPACED_DOMAIN.finditer(out.text) for d in _SPACED_DOT.finditer(m[0])]
    out.splice([(a, b, [(".", a, b)]) for a, b in dots])
    return out


def find_all(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of a text, each by kind, then start."""
    base = find_base(text)
    hidden = rewrite(text)
    if hidden is None:
        return base, base
    added = []
    for kind, a, b in find_base(hidden.text):
        if not any(hidden.new[a:b]):
            continue
        x, y = hidden.start[a], hidden.end[b - 1]
        if not any(k == kind and p <= x and y <= q for k, p, q in base):
            added.append((kind, x, y))
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(it):
    import pyarrow as pa

    for batch in it:
        ids, texts = batches(batch, ["doc_id", "text"])
        counts: list[list[int]] = [[] for _ in KINDS]
        sums, spans, added = [], [], []
        for t in texts:
            base, every = find_all(t.as_py() or "")
            for k, column in zip(KINDS, counts):
                column.append(sum(s[0] == k for s in base))
            sums.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(every))
            added.append(len(every) - len(base))
        yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added.

    The counts and ``base_sha256`` are of the base spans; ``spans`` lists all, ``n_added``
    of which deobfuscation found.  Spans are kind:start:end in code points, end
    exclusive, by kind (email, ip, card, phone), then start.  Null text is empty and
    has none.  Other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def _mask(it):
    import pyarrow as pa

    for batch in it:
        ids, texts = batches(batch, ["doc_id", "text"])
        out = []
        for t in texts.to_pylist():
            if t is not None:
                parts, at = [], 0
                for kind, a, b in sorted(find_all(t)[1], key=lambda s: (s[1], -s[2])):
                    if a >= at:
                        parts += [t[at:a], f"<{kind}>"]
                    at = max(at, b)
                t = "".join(parts) + t[at:]
            out.append(t)
        yield pa.record_batch([ids, pa.array(out, pa.string())], names=["doc_id", "text"])


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and text with every span replaced by its kind in angle brackets; null text stays null."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_mask, "doc_id long, text string")
