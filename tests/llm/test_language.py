import zlib

import numpy as np
import public_tokenizers

from gleaner.llm import language

PATH = public_tokenizers.path("piece_bpe_32k.model")
EN = "the house and the garden where the children were playing with their friends this morning".split()
DE = "das haus und der garten wo die kinder heute morgen mit ihren freunden gespielt haben".split()
SCHEMA = "doc_id long, text string, lang string, source string"


def by_hand(word, pieces, table):
    """The sum over all ways to cut the word."""
    index = {t: i for i, t in enumerate(pieces.texts)}

    def total(rest):
        if not rest:
            return 1.0
        out = 0.0
        for k in range(1, min(len(rest), pieces.longest) + 1):
            if rest[:k] in index:
                out += table[index[rest[:k]]] * total(rest[k:])
            elif k == 1:
                out += language.UNKNOWN * total(rest[1:])
        return out

    return total(word)


def test_forward_sums_all_segmentations_and_counts_follow():
    pieces = language.Pieces(PATH)
    draw = np.random.default_rng(3)
    table = draw.dirichlet(np.ones(len(pieces.texts)))
    words = ["▁the", "▁haus", "▁ωx", "a", "▁kinder"]
    got = np.exp(language.word_scores(words, pieces, np.r_[table, language.UNKNOWN][:, None]))[:, 0]
    assert np.allclose(got, [by_hand(w, pieces, table) for w in words], rtol=1e-9)
    counts = language.piece_counts(["▁the"], np.array([2.0]), pieces, table)
    # The expected length of the pieces, weighted, is the word's.
    assert np.isclose(sum(c * len(t) for c, t in zip(counts, pieces.texts)), 2 * len("▁the"))


def test_long_words_are_summed_whole(monkeypatch):
    """In logarithms, one by one, as in batches; and however long."""
    pieces = language.Pieces(PATH)
    draw = np.random.default_rng(4)
    tables = np.r_[draw.dirichlet(np.ones(len(pieces.texts)), 2).T, np.full((1, 2), language.UNKNOWN)]
    words = ["▁donaudampfschifffahrt", "▁ωxthe", "a", "▁garden"]
    want, counts = language.word_scores(words, pieces, tables), language.piece_counts(words, np.arange(1.0, 5.0), pieces, tables[:-1, 0])
    monkeypatch.setattr(language, "LONG", 0)
    assert np.allclose(language.word_scores(words, pieces, tables), want)
    assert np.allclose(language.piece_counts(words, np.arange(1.0, 5.0), pieces, tables[:-1, 0]), counts)
    long = language.word_scores(["▁" + "the" * 3000], pieces, tables)
    assert np.isfinite(long).all() and (long < -3000).all()


def test_words_are_letters_with_their_marks():
    assert language.units("² ½ ³12") == [] and language.units("हिन्दी") == ["▁हिन्दी"]
    assert language.units("e\u0301te\u0301") == language.units("été") == ["▁été"]
    assert language.units("d'Été-x2y\u0301") == ["▁d", "▁été", "▁x", "▁ý"]
    assert language.units("\u0301") == [] and language.units("a" * 500) == ["▁" + "a" * 500]


def test_prediction_equals_its_definition(spark):
    """Score and language of whole texts, from the model's own probabilities, word by word."""
    rows = docs(spark, 120)
    languages, table = language.train(rows.select("doc_id", "text", "lang"), PATH)
    got = {r["doc_id"]: r for r in language.predict(rows, languages, table, PATH).collect()}
    pieces = language.Pieces(PATH)
    for r in rows.limit(6).collect():
        words = [u for w in r["text"].split() for u in language.units(w)]
        logs = np.array([sum(np.log(by_hand(w, pieces, table[:, k])) for w in words) for k in range(len(languages))]) / np.sqrt(len(words))
        share = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert got[r["doc_id"]]["lang_pred"] == languages[int(share.argmax())]
        assert np.isclose(got[r["doc_id"]]["score"], share.max())


def docs(spark, n=400):
    draw = np.random.default_rng(1)
    rows = [(i, " ".join(draw.choice(EN if i % 2 else DE, 12)), "en" if i % 2 else "de", None) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_held_out_accuracy(spark):
    got = language.identify(docs(spark), PATH).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    out = [r for r in got if r["held_out"]]
    assert len(out) > 50 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    from pyspark.sql import functions as F

    rows = docs(spark)
    other = rows.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang"))).withColumn("source", F.col("lang"))
    a = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language.identify(rows, PATH).collect()}
    b = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language.identify(other, PATH).collect()}
    assert a == b


def test_odd_texts(spark):
    odd = [(1000, None, "en", "x"), (1001, "", "de", "x"), (1002, "12 34 !? ² ½", None, "x"), (1003, "the " * 60_000, None, "x"), (1004, "x" * 100_000, None, "x"), (None, "das haus", None, "x"), (1003, "the " * 60_000, None, "x")]
    rows = docs(spark).union(spark.createDataFrame(odd, SCHEMA)).selectExpr("*", "'own' as lang_pred", "0 as __gleaner")
    got = [r for r in language.identify(rows, PATH).collect() if r["doc_id"] is None or r["doc_id"] >= 1000]
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(odd)
    assert (by[1000], by[1001], by[1002], by[1003], by[None]) == ("und", "und", "und", "en", "de")
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")


def test_bytes_that_are_no_utf8(spark):
    from pyspark.sql import functions as F

    rows = docs(spark).union(spark.createDataFrame([(1000, "das haus", None, None), (1001, "", None, None)], SCHEMA))
    bad = rows.withColumn("text", F.when(F.col("doc_id") >= 1000, F.concat("text", F.lit(" "), F.expr("cast(x'ff80c3' as string)"))).otherwise(F.col("text")))
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(bad, PATH).where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "und"}


def test_no_labels_or_no_rows(spark):
    got = language.identify(spark.createDataFrame([(1, "the house", None, None)], SCHEMA), PATH).collect()
    assert [(r["lang_pred"], r["score"]) for r in got] == [("und", 0.0)]
    assert language.identify(spark.createDataFrame([], SCHEMA), PATH).collect() == []
