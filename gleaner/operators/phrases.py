"""Mines weighted phrases from texts, set-wise over many places, and ranks them."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import S, clean_phrase, first_units, js_trim, one_of, plain_spaces, title_case, units
from gleaner.operators.lexicon import FOOD, Lexicon
from gleaner.sources.scratch import materialize

#: UTF-16 units after a trigger that may hold a name; weights of the three ways to find one.
AFTER_TRIGGER = 60
TRIGGERED, QUOTED, PRAISED = 1, 3, 2
MOST_NAMES = 8
#: Ranks of a place that are folded at once; the rest is held against the names kept, round by round, where these do not suffice.
AT_ONCE = 512


def is_valid(phrase: Column, lexicon: Lexicon = FOOD) -> Column:
    """1 to 5 words, 3 to 40 characters, no digit first, no stop word; and a known name, or one that contains a part. Case, and white space
    around the phrase and how much of it between words, do not matter."""
    low = js_trim(F.lower(phrase))
    return _is_valid(low, F.split(low, f"{S}+"), lexicon)


def _is_valid(phrase: Column, words: Column, lexicon: Lexicon) -> Column:
    accepted = F.exists(F.array(*map(F.lit, lexicon.parts)), lambda p: F.contains(phrase, p)) if lexicon.parts else F.lit(False)
    if lexicon.known:
        accepted = phrase.isin(*lexicon.known) | accepted
    out = F.size(words).between(1, 5) & units(phrase).between(3, 40) & ~phrase.rlike(r"\A[0-9]")
    if lexicon.stops:
        out &= ~F.arrays_overlap(words, F.array(*map(F.lit, lexicon.stops)))
    return out & accepted


def _mention(way: int, order: Column, occurrence: Column, weight: int, phrase: Column) -> Column:
    return F.struct(F.lit(way).alias("way"), order.alias("trigger"), occurrence.alias("occurrence"), F.lit(weight).alias("weight"), clean_phrase(phrase).alias("phrase"))


def _found(matches: Column, way: int, weight: int) -> Column:
    return F.transform(matches, lambda m, i: _mention(way, F.lit(0), i, weight, m))


def _triggered(triggers: Sequence[str]) -> Column:
    """What follows each trigger, from one pass over the text: the look-ahead takes a place's longest trigger and all that may follow, and
    uses up nothing, so the next trigger may lie within. A trigger that starts another one is found where that is."""
    kinds = F.array(*[F.struct(F.lit(i).alias("order"), F.lit(t).alias("text")) for i, t in enumerate(triggers)])
    places = F.regexp_extract_all("_text", F.lit(rf"(?s)(?=({one_of(triggers)}.{{0,{AFTER_TRIGGER}}}))"), F.lit(1))

    def each(m: Column, i: Column) -> Column:
        after = lambda k: first_units(F.substring(m, F.length(k["text"]) + 1, F.lit(AFTER_TRIGGER)), AFTER_TRIGGER)
        return F.transform(F.filter(kinds, lambda k: F.startswith(m, k["text"])), lambda k: _mention(1, k["order"], i, TRIGGERED, _after_trigger(after(k))))

    return F.flatten(F.transform(places, each))


#: A word never gives letters back: what must follow a word is no letter, so that would be in vain.
_WORD = "[a-z]++"


def _after_trigger(window: Column) -> Column:
    """Up to four words that end where a clause does; only if there are none such, up to three words."""
    window = plain_spaces(window)
    ended = F.regexp_extract(window, rf"\A({_WORD}(?:\s+{_WORD}){{0,3}})(?=[.,!?;:\n]|\z|\s{{2}})", 1)
    return F.coalesce(F.nullif(ended, F.lit("")), F.regexp_extract(window, rf"\A({_WORD}(?:\s+{_WORD}){{0,2}})", 1))


def mentions(reviews: DataFrame, lexicon: Lexicon = FOOD) -> DataFrame:
    """place, ord, way, trigger, occurrence, weight and phrase of every valid mention in reviews (place, ord, text)."""
    text = F.lower(F.coalesce("text", F.lit("")))
    ways = [_triggered(lexicon.triggers)] if lexicon.triggers else []
    ways.append(_found(F.regexp_extract_all("_plain", F.lit(r"[\"']([a-z][a-z\s]{2,30})[\"']"), F.lit(1)), 2, QUOTED))
    if lexicon.praise:
        # Tried at the start of a word only, or where the last match ended: from within a word it finds no more.
        praise = rf"(?:\G|(?<![a-z]))({_WORD}(?:\s++{_WORD}){{0,3}})\s++(?:is|was|are|were)\s++(?:{'|'.join(map(re.escape, lexicon.praise))})"
        # Most texts have none of the endings, which is seen at the white space before them, in one look.
        some = F.rlike(F.col("_plain"), F.lit(rf"[a-z]\s++(?:is|was|are|were)\s++(?:{'|'.join(map(re.escape, lexicon.praise))})"))
        ways.append(_found(F.when(some, F.regexp_extract_all("_plain", F.lit(praise), F.lit(1))).otherwise(F.array().cast("array<string>")), 3, PRAISED))
    rows = reviews.select("place", "ord", text.alias("_text")).select("place", "ord", "_text", plain_spaces(F.col("_text")).alias("_plain"))
    rows = rows.select("place", "ord", F.explode(F.concat(*ways)).alias("m"))
    return rows.select("place", "ord", "m.*").where(_is_valid(F.col("phrase"), F.split("phrase", " "), lexicon))  # cleaned: lower case, and no other white space


def phrase_weights(reviews: DataFrame, lexicon: Lexicon = FOOD) -> DataFrame:
    """place, phrase, weight and first (the place of its first mention). Sums are made before the shuffle."""
    first = F.struct("ord", "way", "trigger", "occurrence")
    return mentions(reviews, lexicon).groupBy("place", "phrase").agg(F.sum("weight").alias("weight"), F.min(first).alias("first"))


def fold(names: Column, most: int = MOST_NAMES, kept: Column | None = None) -> Column:
    """Walks ranked names and keeps each that neither holds nor is held by one kept before, until there are enough."""
    start = F.array().cast("array<string>") if kept is None else kept

    def step(acc: Column, x: Column) -> Column:
        held = F.exists(acc, lambda e: F.contains(e, x) | F.contains(x, e))
        return F.when((F.size(acc) >= most) | held, acc).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(names, start, step)


def popular_phrases(reviews: DataFrame, lexicon: Lexicon = FOOD, most: int = MOST_NAMES, at_once: int = AT_ONCE) -> DataFrame:
    """place and names, at most `most` title-cased phrases: heaviest first, of equal ones the first mentioned, none holding another.

    A place's phrases are ranked by a limit that works before the shuffle, so even a place with a third of all reviews puts no more
    than at_once of them into a row. If these leave names wanting, the phrases that no kept name touches are ranked in another round.
    """
    rank = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("weight"), "first"))
    left = materialize(phrase_weights(reviews, lexicon), "phrases")
    done = None

    def same_place(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        """Null is a place as any other."""
        return a.join(b.withColumnRenamed("place", "_place"), F.col("place").eqNullSafe(F.col("_place")), how).drop("_place")

    while True:
        top = left.select("place", "phrase", rank.alias("rank")).where(F.col("rank") <= at_once)
        found = top.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda s: s["phrase"]).alias("ranked"))
        if done is None:
            kept = found.select("place", fold(F.col("ranked"), most).alias("kept"))
        else:
            kept = same_place(done, found, "left").select("place", F.coalesce(fold(F.col("ranked"), most, F.col("kept")), "kept").alias("kept"))
        crowded = left.groupBy("place").count().where(F.col("count") > at_once).select("place")
        if crowded.isEmpty():
            break
        done = materialize(kept, "kept")
        wanting = same_place(done.where(F.size("kept") < most), crowded)
        free = ~F.exists("kept", lambda k: F.contains(k, F.col("phrase")) | F.contains(F.col("phrase"), k))
        left = materialize(same_place(left, wanting).where(free).drop("kept"), "phrases")
    return kept.select("place", F.transform("kept", title_case).alias("names"))
