"""The corpus pipeline: language ID, SimHash near-dedup, substring dedup, mixing to target weights, SentencePiece encoding.

Every stage keeps the columns of its input, whatever their names: those that an operator would replace are set aside and come back.
A null text is an empty one; a null doc_id is a document without a name, see each stage; an empty table passes as an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import language, mixing, piece_codec, simhash, suffixes
from gleaner.llm.common import drop, read, set_aside, settled

PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: A document goes if its language cannot be told: no letters, or a score below this.
LEAST_SCORE = 0.5


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language cannot be told: null and empty texts, texts without a letter, low scores. Learns from the labelled
    rows that are not held out. Rows that repeat are told alike."""
    own, back = set_aside(docs, "held_out", "lang_pred", "score")
    found = language.identify(own, PIECES)
    return back(found.where((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: sets of five-word shingles with a similarity of 0.8 or more.

    SimHash fingerprints, at a wide radius, find the candidates, whose sets are then held against each other: a link is never below 0.8, and
    one in fifty at 0.8 may be missed (simhash.MISS). At that radius distances to pivots tell hardly any pair apart, so one is used, as a
    window; op8_simhash uses them all. Rows without a doc_id stay, and so do rows that repeat the doc_id of one that stays.
    """
    return simhash.keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that a document with a smaller doc_id has; n_chars, where there is one, follows the text, and a
    document of which nothing is left goes. A null doc_id counts as the largest; rows with equal doc_ids do not touch each other."""
    own, back = set_aside(docs, "n_words", "n_removed")
    cut = suffixes.remove_repeats(own)
    out = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0))
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, length).otherwise(F.col("n_chars")))
    return back(out)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in whole copies drawn without bias: see mixing.copies. Documents without words go; rows of
    a source that share a doc_id, or have none, go together."""
    often = mixing.copies(mixing.mix(docs)).select(F.col("doc_id").alias("__gleaner_id"), F.col("source").alias("__gleaner_source"), F.col("times").alias("__gleaner_times"))
    joined = docs.join(often, docs["doc_id"].eqNullSafe(often["__gleaner_id"]) & docs["source"].eqNullSafe(often["__gleaner_source"]))
    return joined.withColumn("__gleaner_time", F.explode(F.sequence(F.lit(1), F.col("__gleaner_times")))).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, whether they decode to its text, and whether they are those of the sentencepiece library. Columns of the
    input that have the names of these results give way to them; the text goes."""
    return piece_codec.encode(docs, PIECES)


STAGES = [("language ID", by_language), ("SimHash near-dedup", near_duplicates), ("substring dedup", substrings), ("mixing", mixed), ("SentencePiece", pieces)]

#: No stage but the mixing's sums can be said in SQL: see the brute-force test.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again, and goes when the next one is written.
    What a stage writes on its way goes with it."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
