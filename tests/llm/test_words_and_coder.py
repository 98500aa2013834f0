import random

import numpy as np
import pytest

from gleaner.llm import words as w
from gleaner.llm.coder import UnitCoder
from gleaner.llm.components import local_roots

TEXTS = [b"", b" ", b"a", b"a b  c\td\n", b"\xc2\x85x \x1cy\x0bz", "é ü ß x".encode(), b"x" * 200_000 + b" y " + b"z " * 70_000]


def test_words_are_runs_of_other_bytes_than_ascii_space():
    found = w.words_of(TEXTS)
    assert [found.word(i) for i in range(len(found.start))] == [x for t in TEXTS for x in t.split()]
    assert found.counts.tolist() == [len(t.split()) for t in TEXTS]


def test_hashes_tell_words_apart_wherever_they_lie():
    draw = random.Random(1)
    texts = [b" ".join(bytes(draw.choices(b"ab", k=draw.randint(1, 12))) for _ in range(5000)) for _ in range(8)]
    found = w.words_of(texts + TEXTS)
    by = {}
    for i, h in enumerate(found.hashes().tolist()):
        assert by.setdefault(h, found.word(i)) == found.word(i)
    assert len(by) == len({found.word(i) for i in range(len(found.start))})


@pytest.mark.parametrize("size", [1, 3, 13])
def test_windows_stay_within_texts(size):
    draw = random.Random(2)
    texts = [b" ".join(draw.choices([b"a", b"b"], k=draw.randint(0, 30))) for _ in range(200)]
    found = w.words_of(texts)
    hashes, at = w.windows(found.hashes(), found.counts, size)
    flat = [x for t in texts for x in t.split()]
    want = [(tuple(flat[a + k : a + k + size]), a + k) for a, n in zip(found.first, found.counts) for k in range(n - size + 1)]
    assert at.tolist() == [k for _, k in want]
    by = {}
    for h, (words, _) in zip(hashes.tolist(), want):
        assert by.setdefault(h, words) == words
    assert len(by) == len({x for x, _ in want})


def test_slices_cover_texts_in_order():
    texts = [b"x" * n for n in (0, 5, 100, 3, 0)]
    parts = list(w.slices(texts, 50))
    assert [i for s in parts for i in range(s.start, s.stop)] == list(range(5)) and len(parts) > 1
    assert list(w.slices([])) == []


def test_coder_encodes_each_unit_once_and_starts_anew_when_full():
    seen = []

    def encode(units):
        seen.extend(units)
        return [[ord(c) for c in u] for u in units]

    coder = UnitCoder(encode, most=4)
    for _ in range(2):
        ids, n = coder(w.words_of([b"ab a", b"", b"a ab a"]))
        assert (bytes(ids.astype(np.uint8)), n.tolist()) == (b"abaaaba", [3, 0, 4])
    assert sorted(seen) == ["a", "ab"]
    ids, n = coder(w.words_of([b"c d e", b"ab"]))
    assert bytes(ids.astype(np.uint8)) == b"cdeab" and len(seen) == 6


def test_local_roots():
    draw = np.random.default_rng(4)
    for n in (1, 2, 30):
        a, b = draw.integers(0, n, 20), draw.integers(0, n, 20)
        root = list(range(n))
        for _ in range(n):
            for x, y in zip(a, b):
                root[x] = root[y] = min(root[x], root[y])
        assert local_roots(n, a, b).tolist() == root


def thue_morse(a, b, n=1024):
    """A word of which the polynomial hash, modulo 2**64, equals that of the same with a and b swapped."""
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n)).encode()


def test_words_are_told_apart_by_their_bytes():
    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    found = w.words_of([x, y, x])
    assert len(set(found.hashes().tolist())) == 1  # what makes the case
    kinds, number = found.distinct()
    assert [kinds.word(0), kinds.word(1), len(kinds.start)] == [x, y, 2] and number.tolist() == [0, 1, 0]
    coder = UnitCoder(lambda units: [[ord(u[0]), len(u)] for u in units])
    ids, n = coder(found)
    assert ids.tolist() == [97, 1024, 98, 1024, 97, 1024] and n.tolist() == [2, 2, 2]
    coder.clear()
    assert coder(w.words_of([y]))[0].tolist() == [98, 1024] and coder(w.words_of([x]))[0].tolist() == [97, 1024]


def test_known_words_are_found_and_others_not():
    draw = random.Random(4)
    known, want = w.Known(), {}
    for _ in range(30):
        found, _ = w.words_of([b" ".join(bytes(draw.choices(b"abc", k=draw.randint(1, 5))) for _ in range(40)) + b" " + thue_morse("a", "b") + b" " + thue_morse("b", "a")]).distinct()
        rows, hashes = known.find(found)
        for i, r in enumerate(rows.tolist()):
            assert (r < 0 and found.word(i) not in want) or want.get(found.word(i)) == r or (r < 0 and len(found.word(i)) == 1024)
        fresh = np.flatnonzero(rows < 0)
        for k, i in enumerate(fresh.tolist()):
            if len(found.word(i)) != 1024 or found.word(i) not in want:
                want[found.word(i)] = len(known) + k
        known.add(found, hashes, fresh)
    assert len(known.keys) < len(known)  # one of the two long words is never kept


def test_colliding_words_in_each_operator(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from gleaner.llm import language, piece_codec, queries, token_files

    x, y = thue_morse("a", "b").decode(), thue_morse("b", "a").decode()
    ids = lambda t: Tokenizer.from_file(queries.WORD_BPE).encode(t, add_special_tokens=False).ids
    assert ids(x) != ids(y)
    flat, n = token_files.encode_texts([x.encode(), y.encode()], queries.WORD_BPE)
    assert flat.tolist() == ids(x) + ids(y)
    flat, _ = token_files.encode_texts([y.encode()], queries.WORD_BPE)
    assert flat.tolist() == ids(y)
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    for parts in (1, 2):
        rows = spark.createDataFrame([(1, x), (2, y), (3, f"{y} {x}")], "doc_id long, text string").coalesce(1).repartition(parts)
        for r in piece_codec.encode(rows, queries.PIECES).collect():
            text = {1: x, 2: y, 3: f"{y} {x}"}[r["doc_id"]]
            assert r["piece_ids"] == pieces.encode(text) and r["round_trip"] and r["parity"]
    own = language._pieces(queries.PIECES)
    train = spark.createDataFrame([(i, "a " * 50, "aa") for i in range(20)] + [(i + 100, "b " * 50, "bb") for i in range(20)], "doc_id long, text string, lang string")
    languages, table = language.train(train, queries.PIECES)
    for texts in ([x, y], [y, x]):
        got = {r["text"]: r["score"] for r in language.predict(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1), languages, table, queries.PIECES).collect()}
        for t in texts:
            alone = language.predict(spark.createDataFrame([(t,)], "text string"), languages, table, queries.PIECES).first()["score"]
            assert got[t] == pytest.approx(alone)
    assert own.longest > 1 and public_tokenizers


def test_columns_that_differ_in_case(spark):
    from gleaner.llm import language, piece_codec, queries, suffixes, token_files

    docs = spark.createDataFrame([(1, "one two three", "en", 5, 6, 7, 8, "x", None)], "doc_id long, text string, lang string, Score int, Parity int, N_WORDS int, Held_Out int, Text string, Lang string")
    got = language.identify(docs, queries.PIECES)
    assert got.columns == ["doc_id", "text", "lang", "Parity", "N_WORDS", "Text", "Lang", "held_out", "lang_pred", "score"] and got.first()[5] == "x"
    got = piece_codec.encode(docs, queries.PIECES)
    assert got.columns == ["doc_id", "lang", "Score", "N_WORDS", "Held_Out", "Text", "Lang", "piece_ids", "n_pieces", "round_trip", "parity"] and got.first()[-1] is True and got.first()[5] == "x"
    got = suffixes.remove_repeats(docs)
    assert got.columns == ["doc_id", "text", "lang", "Score", "Parity", "Held_Out", "Text", "Lang", "n_words", "n_removed"] and tuple(got.first())[-2:] == (3, 0)
    assert token_files.read_shards(token_files.write_shards(docs, queries.WORD_BPE)).count() == 1
