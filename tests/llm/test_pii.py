import random
import re
import time

import pytest

from treeledger.llm import pii

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = (
                kind == 0
                or kind == 1 and all(int(p) <= 255 for p in m[0].split("."))
                or kind == 2 and 14 <= len(digits) <= 19 and pii.luhn(digits)
                or kind == 3 and 10 <= len(digits) <= 15
            )
            if fine:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    random.seed(2)
    parts = ["a", "b.", "@", ".", "1", "22", "+", "+1", "-", " ", "(", ")", "255", "256", "4111 1111 1111 1111", "x@y.z", "%", "é", "0"]
    for _ in range(15000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 16)))
        assert pii.base_spans(text) == brute(text), text


@pytest.mark.parametrize(
    "text,kind,said",
    [
        ("mail john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"),
        ("john [at] mail dot example dot com.", "email", "john [at] mail dot example dot com"),
        ("write to anna at example dot org please", "email", "anna at example dot org"),
        ("call plus one four one five five five five two six seven one now", "phone", "plus one four one five five five five two six seven one"),
        ("ip 10 dot 0 dot 0 dot 1 end", "ip", "10 dot 0 dot 0 dot 1"),
        ("jоhn@ехample.com", "email", "jоhn@ехample.com"),
        ("ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, said):
    base, spans = pii.find(text)
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, said)] and base == []
    assert said not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text", ["look at the dot here", "four five six apples", "at the point of no return", "", "one one two", "été à l'ombre"])
def test_clean_texts_stay_clean(text):
    assert pii.find(text) == ([], []) and pii.redact(text) == text


def test_base_spans_stay_beside_added_ones():
    text = "a@b.de and anna at example dot org"
    base, spans = pii.find(text)
    assert set(base) < set(spans) and len(spans) == 2


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "x" * 500_000 + "@"):
        pii.find(text)


def test_table(spark):
    docs = spark.createDataFrame([(1, "me@x.org +1 (988) 555-2485", "en", "s", 3, 9), (1, None, None, None, None, 1), (None, "", "en", "s", 0, 2)], "doc_id bigint, text string, lang string, source string, n_chars bigint, spans int")
    got = sorted(map(tuple, pii.detect(docs).collect()), key=str)
    assert [r[:5] for r in got] == [(1, 0, 0, 0, 0), (1, 1, 0, 0, 1), (None, 0, 0, 0, 0)]
    assert got[1][6] == "email:0:8,phone:9:26"
    clean = {r.text for r in pii.redact_table(docs).collect()}
    assert clean == {"[EMAIL] [PHONE]", None, ""}
    assert pii.detect(docs.limit(0)).collect() == []


@pytest.mark.parametrize(
    "kind,said",
    [
        *(("email", x) for x in ("jane{@}example{.}com", "jane<@>example.com", "jane[ @ ]example.com", "jane( @ )example( . )com", "jane@example{point}com", "jane@example[ punkt ]com", "jane@example dot\ncom")),
        *(("email", x) for x in ("jane at example dot nl", "jane.doe at example dot museum", "jane at mail dot example dot museum", "jane@example dot museum", "jane [at] example dot museum")),
        ("phone", "plus one four one five one one one one one one one"),
        ("ip", "ten dot one dot two dot three".replace("ten", "one zero")),
        ("ip", "one nine two dot one six eight dot 0 dot one"),
        ("ip", "one[.]two[.]three[.]four"),
    ],
)
def test_every_form_of_the_transducers_is_found(kind, said):
    for text in (said, f"so {said} ."):
        base, spans = pii.find(text)
        assert [(pii.KINDS[k], text[a:b]) for a, k, b in spans] == [(kind, said)] and base == []


def test_conditions_of_the_transducers_lose_nothing(monkeypatch):
    random.seed(3)
    parts = ["jane", "a1", "com", "x", "nl", "at", "AT", "dot", "Dot", "punkt", "@", ".", "[", "]", "(", ")", "{", "}", "<", ">", " ", " ", "\n", "-", ",", "one", "Two", "ſix", "sıx", "seven", "zero", "double ", "plus ", "10", "7", "＠", "е", "​"]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(1, 24))) for _ in range(20000)]
    texts += [f"jane{a}{s}at{s}{b}example{a}{s}{d}{s}{b}com" for a, b in ("[]", "()", "{}", "<>") for s in ("", " ") for d in (".", "dot", "punkt", "punto", "point")]
    texts += [" dot ".join(random.choice(("one", "two five", "one nine two", "10", "double one")) for _ in range(4)) for _ in range(200)]
    with_it = [pii.find(t) for t in texts]
    monkeypatch.setattr(pii, "worth", lambda text, edits: True)
    assert with_it == [pii.find(t) for t in texts]
    assert sum(len(spans) > len(base) for base, spans in with_it) > 200


def test_long_disguises_take_linear_time():
    for text in (" at a" + " dot a" * 50_000 + " ", "a at " + "a." * 50_000, "one " * 50_000, "one dot " * 50_000, "[" * 100_000, "a@" + "b" * 200_000):
        pii.find(text)


@pytest.mark.parametrize(
    "text,clean",
    [
        ("so jane dot doe at example dot com .", "so [EMAIL] ."),
        ("so jаne@example.com .", "so [EMAIL] ."),  # one letter is Cyrillic
        ("so jane at example dot ch .", "so [EMAIL] ."),
        ("a@b.de jаne.ｄoe@example.com", "[EMAIL] [EMAIL]"),
    ],
)
def test_redaction_leaves_no_part_of_an_address(text, clean):
    base, spans = pii.find(text)
    assert set(base) <= set(spans) and pii.redact(text) == clean


def test_many_signs_take_linear_time():
    began = time.perf_counter()
    for text in ("x@y " + "a dot " * 170_000, "a at " * 200_000, "a at b dot " * 90_000, "a dot " * 170_000 + "at b dot com", "a@b.com " * 100_000 + "jаne"):
        pii.find(text)
    assert time.perf_counter() - began < 20
