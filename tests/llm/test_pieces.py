import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from gleaner.llm import piece_codec, piece_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b ", "It's\n\t 12 été <s> x y 😀𐍈 z", "a     b", "\x00 a", "Hello world", "x" * 50_000 + " y", "der die das " * 20_000]


def test_parity_with_sentencepiece_and_round_trip():
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    own = piece_codec.Codec(PATH)
    ids, n, parity = own.encode([t.encode() for t in TEXTS])
    assert parity.all()
    at = 0
    for text, size in zip(TEXTS, n):
        assert ids[at : at + size].tolist() == theirs.encode(text), text[:40]
        at += size
    assert own.decode(ids, n) == TEXTS == [theirs.decode(theirs.encode(t)) for t in TEXTS]


def test_random_texts_have_parity_and_come_back():
    """Ten thousand texts of awkward characters, the word mark among them, each held whole against the sentencepiece library."""
    draw = random.Random(6)
    signs = [" ", "  ", "   ", "▁", "\n", "\t", "0", "9", "x", "The", "house", "é", "e\u0301", "ß", "😀", "𐍈", "<s>", "</s>", "<unk>", "<0x0A>", "\u2028", "\u00a0", "\u3000", "'s", "-", ".", "हिन्दी", "\x00"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 14))) for _ in range(10_000)]
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for verify in ("units", "texts"):
        own = piece_codec.Codec(PATH, verify)
        ids, n, parity = own.encode([t.encode() for t in texts])
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert [t for t, a, b in zip(texts, got, theirs.encode(texts)) if a != b] == [] and parity.all()
    back = own.decode(ids, n)
    assert back == theirs.decode(got)
    assert [t for t, b in zip(texts, back) if "▁" not in t and t != b] == []


def test_texts_without_parity_are_told(spark, monkeypatch):
    own = piece_codec.Codec(PATH)
    real = own.own.encode_batch_fast
    monkeypatch.setattr(own, "own", type("Wrong", (), {"encode_batch_fast": lambda self, units, **k: real([u.replace("odd", "even") for u in units], **k)})())
    _, _, parity = own.encode([b"an odd one", b"fine", b"odd", b""])
    assert parity.tolist() == [False, True, False, True]


def test_bytes_that_are_no_utf8_and_the_mark(spark):
    rows = spark.range(3).selectExpr("id as doc_id", "case id when 0 then cast(x'61ff62' as string) when 1 then 'a▁ b' else 'a b' end as text")
    got = {r["doc_id"]: r for r in piece_codec.encode(rows, PATH, strict=True).collect()}
    assert [(got[i]["round_trip"], got[i]["parity"]) for i in range(3)] == [(False, True), (False, True), (True, True)]


def test_whole_texts_without_units():
    tokenizer = piece_codec.build(piece_model.load(PATH))
    theirs = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [e.ids for e in tokenizer.encode_batch(TEXTS[:7], add_special_tokens=False)] == theirs.encode(TEXTS[:7])


def test_unigram_models_are_built_too():
    def field(n, kind, value):
        out = bytearray()
        for x in [n << 3 | kind, *([len(value)] if kind == 2 else [])]:
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        return bytes(out) + value

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁", -3.0, 1), ("a", -2.5, 1), ("▁ab", -2.0, 1), *((f"<0x{i:02X}>", -9.0, 6) for i in range(256))]
    model = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    model += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))
    parsed = piece_model.parse(model)
    assert (parsed.kind, parsed.byte_fallback, parsed.remove_extra_whitespaces, len(parsed.pieces)) == (piece_model.UNIGRAM, True, False, 262)
    tokenizer = piece_codec.build(parsed)
    assert tokenizer.encode("ab ba", add_special_tokens=False).tokens == ["▁ab", "▁", "b", "a"]
    assert tokenizer.encode("é", add_special_tokens=False).tokens == ["▁", "<0xC3>", "<0xA9>"]


def test_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(1, "a b", 1.5, "n"), (None, None, None, None), (1, "a b", 2.5, "n"), (4, "", 1.0, "m")], "doc_id int, text string, n_pieces double, lang string")
    got = piece_codec.encode(rows, PATH)
    assert got.columns == ["doc_id", "lang", "piece_ids", "n_pieces", "round_trip", "parity"] and dict(got.dtypes)["doc_id"] == "int"
    want = sentencepiece.SentencePieceProcessor(model_file=PATH).encode("a b")
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted([(1, "n", want, len(want), True, True)] * 2 + [(None, None, [], 0, True, True), (4, "m", [], 0, True, True)], key=str)
    back = piece_codec.decode(got.withColumn("piece_ids", F.when(F.col("lang") != "m", F.col("piece_ids"))), PATH)
    assert sorted(str(r["text"]) for r in back.collect()) == ["None", "None", "a b", "a b"]
    assert piece_codec.encode(rows.limit(0), PATH).collect() == []
