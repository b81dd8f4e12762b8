import hashlib
import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from treeledger.llm import piece_codec as pc  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def samples():
    random.seed(1)
    letters = " ▁ab\n\t\0é日😀<0xA>s/.,   tionhe "
    return ["", "a", " ", "▁", "the the", "x" * 5000, "a  b", *("".join(random.choice(letters) for _ in range(random.randint(0, 30))) for _ in range(1500))]


def test_ids_and_texts_equal_the_library(library):
    m = pc.model(PATH)
    for text in samples():
        ids = library.encode(text)
        assert m.encode(text) == ids and m.decode(ids) == library.decode(ids), text


def test_any_ids_decode_like_the_library(library):
    m = pc.model(PATH)
    random.seed(3)
    for _ in range(2000):
        ids = [random.choice([random.randrange(32000), random.randrange(260)]) for _ in range(random.randint(0, 6))]
        assert m.decode(ids) == library.decode(ids), ids


def test_spans_cover_the_original_bytes():
    m = pc.model(PATH)
    for text in samples():
        spans = m.encode_spans(text)
        assert [s[0] for s in spans] == m.encode(text)
        raw = text.encode()
        at = 0
        for i, a, b in spans:
            assert a <= b and a <= at <= b or a == at
            at = max(at, b)
            if m.kinds[i] == pc.NORMAL:
                assert m.pieces[i].replace(pc.SPACE, " ").endswith(raw[a:b].decode().replace(pc.SPACE, " "))
        assert at == len(raw)


def test_spans_as_arrays_equal_those_by_characters(library):
    m = pc.model(PATH)
    for text in samples():
        said = ",".join(map(str, library.encode(text)))
        begins, ends = m.span_arrays(text, said)
        assert [tuple(x) for x in zip(begins.tolist(), ends.tolist(), strict=True)] == [(a, b) for _, a, b in m.encode_spans(text)], text


def test_merges_by_scan_and_by_heap_agree(monkeypatch):
    m = pc.model(PATH)
    words = sorted({w for t in samples() for w in m.unit.findall(m.normalise(t)[0]) if len(w) <= 48} | {pc.SPACE + "x" * n + "tion" for n in range(40)})
    assert [m._merged(w) for w in words] == [m._merged_long(w) for w in words]


def compiled(rules):
    """A character map of one-byte keys, laid out as the library lays out its double array."""
    texts, places = b"", {}
    for key, new in rules.items():
        places[key] = len(texts)
        texts += new.encode() + b"\0"
    units = [0] * 512
    units[0] = 256 << 10
    for key, at in places.items():
        c = key.encode()[0]
        node = 256 ^ c
        leaf = 1024 + c  # the value of a key stands where its node's offset leads
        units += [0] * (leaf + 1 - len(units))
        units[node] = c | (1 << 8) | ((leaf ^ node) << 10)
        units[leaf] = at | (1 << 31)
    return struct.pack(f"<I{len(units)}I", 4 * len(units), *units) + texts


def test_character_map_and_alignment():
    m = pc.Model(PATH)
    m.map, m.plain = pc.CharacterMap(compiled({"A": "a", "#": "no", "~": ""})), False
    normal, places = m.normalise("A#~é")
    assert normal == "▁anoé" and places == [0, 0, 1, 1, 3, 5]
    assert m.encode_spans("A#é")[-1][2] == len("A#é".encode())


def test_table(spark, library):
    docs = spark.createDataFrame([(1, "The cat", 5), (1, None, 6), (None, "é\n x", 7)], "doc_id bigint, text string, ids int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pc.digest_table(docs, PATH).collect()}
    want = set()
    for i, t in ((1, "The cat"), (1, ""), (None, "é\n x")):
        ids = library.encode(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == want
    assert all(r.n_bytes == r.spanned_bytes for r in pc.digest_table(docs, PATH).collect())
    back = pc.decode_table(pc.encode_table(docs, PATH), PATH)
    assert {r.text for r in back.collect()} == {"The cat", "", "é\n x"}
    assert pc.digest_table(docs.limit(0), PATH).collect() == []


def test_new_words_are_joined_from_prepared_numbers(monkeypatch):
    m = pc.Model(PATH)
    said = m.joined(m.normalise("unforgettable zorbification 漢字 \U0001f9ff a\nb")[0])
    monkeypatch.setattr(m, "numbers", {})  # each piece by itself
    m.words.clear()
    assert m.joined(m.normalise("unforgettable zorbification 漢字 \U0001f9ff a\nb")[0]) == said and said.count(",") > 6
