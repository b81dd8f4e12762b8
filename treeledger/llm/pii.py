"""PII detection with offset-preserving deobfuscation.

Base detectors find e-mail addresses, IP addresses, card numbers and phone numbers in the text as
it stands. Then transducers rewrite disguises, and record for each character that they put out the
span of source characters that it stands for: look-alike letters and full-width signs become
ASCII; spelled digits become digits (three or more in a row, or any in a dotted address); written-out or bracketed at and dot become their signs. The
base detectors run again on the rewritten text, and the spans that took in a rewritten character
are mapped back to the source. Such spans are added; base ones always stay.

Each document is judged alone, whole, in one pass without an exchange.

Defined cases: a null text is an empty text; an empty text has no spans; repeated rows stay
repeated; an empty table gives an empty table; other columns are ignored. Of texts of any length
the time is in proportion to the length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from treeledger.llm.common import mapped

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
Span = tuple[int, int, int]  # start, number of the kind, end

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
DIGIT = re.compile("[0-9]")
# A match can only begin where a run of digits does, so the look-behind changes nothing but the time.
ADDRESS = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ONLY_DIGITS = str.maketrans("", "", " ().-+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base detectors by start, then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = free = m.end()
            found.append((start, EMAIL, end))
        at = text.find("@", end)
    if DIGIT.search(text):
        for m in ADDRESS.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), IP, m.end()))
        for m in NUMBER.finditer(text):
            digits = m[0].translate(ONLY_DIGITS)
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in CALL.finditer(text):
                if 10 <= len(m[0].translate(ONLY_DIGITS)) <= 15:
                    found.append((m.start(), PHONE, m.end()))
    return sorted(found)


# Look-alike letters of other alphabets, and the ASCII letters they look like.
LOOKALIKES = dict(zip("аеорсхуіјѕԁԛԝһАВЕКМНОРСТХУІЈЅαονικρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcxyijsdqwhABEKMHOPCTXYIJSaovikptABEZHIKMNOPTYX", strict=True))
SIGNS = {"﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "＿": "_", " ": " ", " ": " ", " ": " "}
WIDE = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
GLYPHS = {**LOOKALIKES, **SIGNS, **WIDE}
GLYPH = re.compile("[" + re.escape("".join(GLYPHS)) + "]")
INVISIBLE = re.compile("[​‌‍⁠﻿­]")
# The digits as words.
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
WORD = f"(?a:{'|'.join(SPELLED)})"  # not also by letters that only fold to ASCII ones
TIMES = r"(?:(?:double|triple)\s+)?"
DIGIT_RUN = re.compile(rf"(?<![^\W_])(?:plus[\s-]+)?(?:(?:double|triple)\s+)?(?:{WORD})(?:[\s,-]+(?:(?:double|triple)\s+)?(?:{WORD})){{2,}}(?![^\W_])", re.I)
DIGIT_WORD = re.compile(rf"(?:(double|triple)\s+)?({WORD})", re.I)
AT = r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?"
DOT = r"\s?[\[({<]\s?(?:dot|punkt|punto|point|\.)\s?[\])}>]\s?"
BRACKET_AT, BRACKET_DOT, PLAIN_DOT = re.compile(AT, re.I), re.compile(DOT, re.I), re.compile(r"\sdot\s", re.I)
# Name endings that a short spelled-out address has to have; longer ones may have any.
ENDINGS = "com org net edu gov info io de fr es uk eu nl pl ch se dk fi cz pt ie gr hu ro ru ua jp cn kr br mx ar cl au nz ca za il tr biz dev app xyz"
KNOWN_ENDINGS = frozenset(ENDINGS.split())
ATOM = r"[A-Za-z0-9_%+-]"
#: What stands between the parts of an address: its sign, or the sign written out or in brackets.
BETWEEN = rf"\sat\s|\sdot\s|@|\.|{AT}|{DOT}"
#: Parts that signs join, as many as follow one another: each character is read once.
CHAIN = re.compile(rf"(?<!{ATOM}){ATOM}++(?:(?:{BETWEEN}){ATOM}++)++", re.I)
LINK = re.compile(rf"(?P<part>{ATOM}++)|(?P<sign>{BETWEEN})", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\sdot\s[0-9]{1,3}){3}(?![0-9])", re.I)
OCTET = rf"(?:[0-9]{{1,3}}|{TIMES}{WORD}(?:[\s-]+{TIMES}{WORD}){{0,2}})"
SPELLED_DOTTED = re.compile(rf"(?<![^\W_]){OCTET}(?:(?:\sdot\s|{DOT}){OCTET}){{3}}(?![^\W_])", re.I)
SPELLED_OCTET = re.compile(rf"(?<![^\W_]){TIMES}{WORD}(?:[\s-]+{TIMES}{WORD}){{0,2}}(?![^\W_])", re.I)

Edit = tuple[int, int, str]  # start, end, what replaces it


class Aligned:
    """A rewritten text; of each of its characters the source span, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts, self.ends, self.new = list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)

    def apply(self, edits: list[Edit]) -> None:
        """Makes edits, given by start and without overlap, in one pass."""
        text, starts, ends, new, at = [], [], [], [], 0
        for a, b, said in edits:
            if a < at:
                continue
            text += [self.text[at:a], said]
            starts += [*self.starts[at:a], *[self.starts[a]] * len(said)]
            ends += [*self.ends[at:a], *[self.ends[b - 1]] * len(said)]
            new += [*self.new[at:a], *[True] * len(said)]
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.new = starts + self.starts[at:], ends + self.ends[at:], new + self.new[at:]


def glyph_edits(text: str) -> list[Edit]:
    return sorted([(m.start(), m.end(), GLYPHS[m[0]]) for m in GLYPH.finditer(text)] + [(m.start(), m.end(), "") for m in INVISIBLE.finditer(text)])


def spelled_edits(text: str, start: int, end: int) -> list[Edit]:
    """Edits for spelled digits in a row, each digit by itself."""
    out: list[Edit] = []
    words = list(DIGIT_WORD.finditer(text, start, end))
    if text[start : start + 4].lower() == "plus":
        out.append((start, words[0].start(), "+"))
    for i, m in enumerate(words):
        stop = words[i + 1].start() if i + 1 < len(words) else m.end()
        out.append((m.start(), m.end(), SPELLED[m[2].lower()] * {"double": 2, "triple": 3}.get((m[1] or "").lower(), 1)))
        if stop > m.end():
            out.append((m.end(), stop, ""))
    return out


def digit_edits(text: str) -> list[Edit]:
    """Edits for runs of three or more spelled digits, and for one or two of them in a dotted address."""
    runs = [(m.start(), m.end()) for m in DIGIT_RUN.finditer(text)]
    taken = [False] * len(text) if runs else []
    for a, b in runs:
        taken[a:b] = [True] * (b - a)
    for m in SPELLED_DOTTED.finditer(text):
        runs += [(o.start(), o.end()) for o in SPELLED_OCTET.finditer(text, m.start(), m.end()) if not taken or not any(taken[o.start() : o.end()])]
    return [e for a, b in sorted(runs) for e in spelled_edits(text, a, b)]


def chain_edits(text: str) -> list[Edit]:
    """Edits for the plain ats and dots of addresses, from one walk over the chains of parts and signs.

    After an at, parts joined by dots are a domain, up to the last one that can end a name. Where the at stands as a sign or
    in brackets, any ending will do; for a plain " at " it has to be one of ``ENDINGS``, or the form speaks for an address: a
    name of letters and other signs, or more than one dot. Written-out dots before the at belong to the name.
    """
    out: list[Edit] = []
    for chain in CHAIN.finditer(text):
        links = list(LINK.finditer(text, chain.start(), chain.end()))
        parts, signs = links[::2], links[1::2]
        kinds = ["@" if "@" in s[0] or "at" in s[0].lower() else "." for s in signs]
        free = 0
        for i, kind in enumerate(kinds):
            if kind != "@" or i < free:
                continue
            end = i + 1
            while end < len(kinds) and kinds[end] == "." and LABEL.fullmatch(parts[end][0]):
                end += 1
            while end > i + 1 and not (ending := parts[end][0].strip("-")).isalpha():
                end -= 1
            if end == i + 1 or not LABEL.fullmatch(parts[i + 1][0]) or len(ending) < 2:
                continue
            start = i
            while start > free and kinds[start - 1] == ".":
                start -= 1
            if signs[i][0].isspace() or signs[i][0].strip().lower() == "at":
                name = text[parts[start].start() : signs[i].start()]
                letters = any(c.isalpha() for c in parts[i][0]) and not parts[i][0].replace("-", "").isalpha() or "." in name
                if not (ending.lower() in KNOWN_ENDINGS or letters or end > i + 2) or not any(s[0].strip().lower() == "dot" for s in signs[i + 1 : end]):
                    continue
            out += [(s.start(), s.end(), k) for s, k in zip(signs[start:end], kinds[start:end], strict=True)]
            free = end
    return out


def sign_edits(text: str) -> list[Edit]:
    out = [(m.start(), m.end(), "@") for m in BRACKET_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in BRACKET_DOT.finditer(text)]
    for m in DOTTED.finditer(text):
        out += [(d.start(), d.end(), ".") for d in PLAIN_DOT.finditer(text, m.start(), m.end())]
    out += [e for e in chain_edits(text) if text[e[0] : e[1]] != e[2]]
    return sorted(set(out))


def worth(text: str, edits: object) -> bool:
    """Whether a transducer may have work on a text. Each condition is one that all matches of its patterns need: a
    bracket, the word dot, or three spelled digits."""
    if edits is glyph_edits:
        return not text.isascii()
    low = text.lower()
    if "dot" in low or edits is sign_edits and any(c in text for c in "[({<"):
        return True
    if edits is digit_edits:
        return sum(map(low.count, SPELLED)) >= 3 or any(c in text for c in "[({<") and any(w in low for w in SPELLED)
    return False


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Spans that only show after rewriting, in source offsets, none of them inside a base span of its kind.

    One that takes in more than a base span does, as of a name of which a single letter is a look-alike, stands beside it."""
    aligned = None
    for edits in (glyph_edits, digit_edits, sign_edits):
        now = aligned.text if aligned else text
        if worth(now, edits) and (found := edits(now)):
            aligned = aligned or Aligned(text)
            aligned.apply(found)
    if not aligned or aligned.text == text:
        return []
    out = []
    for start, kind, end in base_spans(aligned.text):
        if any(aligned.new[start:end]) or aligned.ends[end - 1] - aligned.starts[start] != end - start:
            a, b = aligned.starts[start], aligned.ends[end - 1]
            out.append((a, kind, b))
    return [x for x in sorted(set(out)) if not inside(x, base)] if base else out


def inside(span: Span, base: list[Span]) -> bool:
    """Whether a base span of its kind holds a span. Base spans of a kind don't overlap, and stand by start."""
    start, kind, end = span
    for i in range(bisect_right(base, (start, len(KINDS), 0)) - 1, -1, -1):
        if base[i][1] == kind:
            return base[i][2] >= end
    return False


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, by start, then kind."""
    text = text or ""
    base = base_spans(text)
    added = added_spans(text, base)
    return base, sorted([*base, *added]) if added else base


def redact(text: str) -> str:
    """The text with each span, overlapping ones taken together, replaced by its kind in brackets."""
    _, spans = find(text)
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"


def detect(docs: DataFrame) -> DataFrame:
    """The spans of each document; the counts are those of the base detectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digests = pa.array([hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found], pa.string())
            every = pa.array([said(spans) for _, spans in found], pa.string())
            added = pa.array([len(spans) - len(base) for base, spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, every, added], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return mapped(docs.select("doc_id", "text"), run, FOUND)


def redact_table(docs: DataFrame) -> DataFrame:
    """The columns of documents, with text redacted and n_chars its new length; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if t is None else redact(t) for t in batch.column(1).to_pylist()]
            sizes = [None if t is None else len(t) for t in texts]
            columns = [batch.column(0), pa.array(texts, pa.string()), batch.column(2), batch.column(3), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "lang", "source", "n_chars"])

    return mapped(docs.select("doc_id", "text", "lang", "source", "n_chars"), run, "doc_id bigint, text string, lang string, source string, n_chars bigint")
