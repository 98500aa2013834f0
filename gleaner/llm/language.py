"""Language identification by unigrams of pieces, summed over all segmentations.

A word is a run of letters and their marks (Unicode categories L and M, a letter first), lower-cased, in composed form (NFC), with the
vocabulary's word mark before it. Each language has a probability for every piece of a fixed public vocabulary; a word's probability is
the sum over all ways to cut it into pieces, found by the forward algorithm, and a text's is the product over its words. Training is
expectation maximisation with the forward and backward sums, over distinct words that Spark has counted.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import apart, drop, materialize, small_batches, text_bytes
from gleaner.llm.held import held, release
from gleaner.llm.piece_model import NORMAL, SPACE, load
from gleaner.llm.words import Known, slices, words_of

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Longer words go one by one, in logarithms, as products of their probabilities may leave a double.
LONG = 40
#: What a character outside the vocabulary counts for, in every language.
UNKNOWN = 1e-7
#: Training texts of each language, as expected: a hash of the row selects them.
SAMPLE_PER_LANGUAGE = 1500
ROUNDS = 2
MOST_LANGUAGES = 1000
#: Distinct words that a worker keeps, and bytes of them; beyond that it starts anew.
MOST_WORDS = 1_000_000
MOST_BYTES = 32 << 20
UNDETERMINED = "und"
_BITS = 18
_BASE = np.uint64(0x100000001B3)


class Pieces:
    """The vocabulary's pieces of letters, found by a hash of their characters."""

    def __init__(self, path: str):
        texts = {p.lower() for p, _, kind in load(path).pieces if kind == NORMAL and (p == SPACE or LETTERS.fullmatch(p.lstrip(SPACE)))}
        self.texts = sorted(texts)
        self.longest = max(map(len, texts))
        with np.errstate(over="ignore"):
            keys = np.array([self._hash([ord(c) for c in t]) for t in self.texts], dtype=np.uint64)
            assert len(set(keys.tolist())) == len(keys)
            # Open addressing: the slot of a key, or the next free one.
            self.slots = np.full((1 << _BITS) + 64, -1, dtype=np.int32)
            self.slot_keys = np.zeros((1 << _BITS) + 64, dtype=np.uint64)
            self.probes = 0
            for i, (key, at) in enumerate(zip(keys, (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS))):
                n = 0
                while self.slots[int(at) + n] >= 0:
                    n += 1
                self.slots[int(at) + n], self.slot_keys[int(at) + n] = i, key
                self.probes = max(self.probes, n + 1)

    @staticmethod
    def _hash(codes: list[int]) -> int:
        out = 0
        for c in codes:
            out = (out * 0x100000001B3 + c + 1) % 2**64
        return out

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The piece of each key, or -1."""
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int64)
        out = np.full(len(keys), -1, dtype=np.int32)
        left = np.arange(len(keys))
        for n in range(self.probes):
            slot = self.slots[at[left] + n]
            hit = (slot >= 0) & (self.slot_keys[at[left] + n] == keys[left])
            out[left[hit]] = slot[hit]
            left = left[~hit & (slot >= 0)]
            if not len(left):
                break
        return out


def _lattices(words: list[str], pieces: Pieces) -> Iterator[tuple[np.ndarray, int, list[list[np.ndarray]]]]:
    """Words of one length, LONG at most, at a time: their indices, the length, and for each end and piece length (from 1) the pieces there."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) <= LONG:
            by.setdefault(len(w), []).append(i)
    for n, at in by.items():
        codes = _codes("".join(words[i] for i in at)).reshape(len(at), n)
        with np.errstate(over="ignore"):
            ends = []
            hashes: list[np.ndarray] = []
            for j in range(n):
                # The hash of each substring that ends at j, from those that ended at j - 1.
                hashes = [codes[:, j], *(h * _BASE + codes[:, j] for h in hashes[: pieces.longest - 1])]
                ends.append([pieces.find(h) for h in hashes])
        yield np.array(at), n, ends


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)


def _long_lattice(word: str, pieces: Pieces) -> np.ndarray:
    """For each end and piece length (from 1) the piece there, or -1."""
    codes = _codes(word)
    out = np.full((len(codes), pieces.longest), -1, dtype=np.int32)
    hashes = codes
    with np.errstate(over="ignore"):
        for k in range(min(pieces.longest, len(codes))):
            out[k:, k] = pieces.find(hashes)
            hashes = hashes[:-1] * _BASE + codes[k + 1 :] if k + 1 < len(codes) else hashes[:0]
    return out


def _long_steps(found: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """The log probability of each piece of a lattice in each language; logs has the unknown's at the end, which stands for one character."""
    at = np.where(found >= 0, found, len(logs) - 1)
    steps = logs[at]
    steps[:, 1:][found[:, 1:] < 0] = -np.inf
    return steps


def _long_forward(steps: np.ndarray) -> np.ndarray:
    """The log of the sum over segmentations up to each place."""
    n, longest, languages = steps.shape
    out = np.full((n + 1 + longest, languages), -np.inf)  # shifted by longest - 1, so that what lies before the word is -inf
    out[longest - 1] = 0.0
    for j in range(n):
        out[j + longest] = np.logaddexp.reduce(out[j : j + longest][::-1] + steps[j], axis=0)
    return out[longest - 1 : n + longest]


def _forward(n: int, ends: list[list[np.ndarray]], table: np.ndarray) -> list[np.ndarray]:
    """table: a row for each piece, one more for the unknown at the end. Returns the sum over segmentations up to each place."""
    size = len(ends[0][0])
    sums = [np.ones((size, table.shape[1]))]
    for j in range(n):
        total = np.zeros((size, table.shape[1]))
        for k, found in enumerate(ends[j]):
            has = np.flatnonzero(found >= 0)
            if len(has):
                total[has] += sums[j - k][has] * table[found[has]]
            if k == 0:
                no = np.flatnonzero(found < 0)
                total[no] += sums[j][no] * table[-1]
        sums.append(total)
    return sums


def word_scores(words: list[str], pieces: Pieces, table: np.ndarray) -> np.ndarray:
    """The log probability of each word in each language."""
    out = np.zeros((len(words), table.shape[1]))
    for at, n, ends in _lattices(words, pieces):
        out[at] = np.log(np.maximum(_forward(n, ends, table)[-1], 1e-300))
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if long:
        logs = np.log(table)
        for i in long:
            out[i] = _long_forward(_long_steps(_long_lattice(words[i], pieces), logs))[-1]
    return out


def piece_counts(words: list[str], times: np.ndarray, pieces: Pieces, probabilities: np.ndarray) -> np.ndarray:
    """How often each piece is expected in the words, under probabilities of one language."""
    table = np.r_[probabilities, UNKNOWN][:, None]
    out = np.zeros(len(pieces.texts))
    for at, n, ends in _lattices(words, pieces):
        forward = _forward(n, ends, table)
        backward = [np.zeros_like(forward[0]) for _ in range(n)] + [np.ones_like(forward[0])]
        for j in range(n - 1, -1, -1):
            for k, found in enumerate(ends[j]):
                p = np.where(found >= 0, table[found, 0], UNKNOWN if k == 0 else 0.0)[:, None]
                backward[j - k] += p * backward[j + 1]
        scale = (times[at] / np.maximum(forward[-1][:, 0], 1e-300))
        for j in range(n):
            for k, found in enumerate(ends[j]):
                has = found >= 0
                weight = forward[j - k][has, 0] * table[found[has], 0] * backward[j + 1][has, 0] * scale[has]
                out += np.bincount(found[has], weights=weight, minlength=len(out))
    for i, w in enumerate(words):
        if len(w) > LONG:
            found = _long_lattice(w, pieces)
            steps = _long_steps(found, np.log(table))
            # Backwards as forwards: the lattice of pieces by where they start.
            turned = np.full_like(steps, -np.inf)
            for k in range(min(pieces.longest, len(w))):
                turned[: len(w) - k, k] = steps[k:, k]
            forward, backward = _long_forward(steps)[:, 0], _long_forward(turned[::-1])[::-1, 0]
            for k in range(min(pieces.longest, len(w))):
                at = np.flatnonzero(found[:, k] >= 0)
                if len(at):
                    weight = times[i] * np.exp(forward[at - k] + steps[at, k, 0] + backward[at + 1] - forward[-1])
                    out += np.bincount(found[at, k], weights=weight, minlength=len(out))
    return out


def units(word: str) -> list[str]:
    """The runs of letters and marks in a word, lower-cased, composed, and marked."""
    low = word.lower()
    if not low.isascii():
        low = unicodedata.normalize("NFC", low)
    if low.isalpha():
        return [SPACE + low]
    return [SPACE + run for run in LETTERS.findall(low)]


def _pieces(path: str) -> Pieces:
    return held(("language", path), lambda: Pieces(path))


def train(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE_PER_LANGUAGE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, in order, and the probability of each piece in each. labelled: doc_id, text, lang; null languages are left out.

    About sample rows of each language are used, or all of them where there are fewer; a hash of doc_id and text selects them. The
    driver takes a count for each language and a number for each piece and language, both bounded by the vocabulary and MOST_LANGUAGES.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    rows = labelled.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages, pieces = sorted(sizes), _pieces(vocabulary)
    n = len(pieces.texts)
    if not languages:
        return [], np.zeros((n, 0))
    share = spark.createDataFrame([(k, min(1.0, sample / sizes[k])) for k in languages], "lang string, share double")
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                texts = texts.tolist()
                for s in slices(texts):
                    w = words_of(texts[s])
                    distinct, number = w.distinct()
                    times = np.bincount(number, minlength=len(distinct.start))
                    flat = [(u, t) for i, t in enumerate(times.tolist()) for u in units(distinct.word(i).decode("utf-8", "replace"))]
                    yield pd.DataFrame(flat, columns=["word", "n"]).assign(lang=lang)
        release()

    counted = picked.select("lang", text_bytes().alias("text")).mapInPandas(count, "word string, n long, lang string")
    words = materialize(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words")
    table = np.full((n, len(languages)), 1.0 / n)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(table)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own, now = _pieces(vocabulary), sent.value
            total = np.zeros((n, len(languages)))
            for pdf in batches:
                for lang, part in pdf.groupby("lang"):
                    k = languages.index(lang)
                    total[:, k] += piece_counts(part["word"].tolist(), part["n"].to_numpy(dtype=float), own, now[:, k])
            at, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": at, "lang": lang, "n": total[at, lang]})

        found = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "piece"])
        counts = np.zeros((n, len(languages)))
        counts[found["piece"], found["lang"]] = found["n"].round(6)
        # Each language leans on all of them together, and those on evenness, for pieces it has rarely seen.
        everywhere = (counts.sum(1) + 0.01) / (counts.sum() + 0.01 * n)
        table = (counts + 200 * everywhere[:, None]) / (counts.sum(0) + 200)
    drop(words)
    return languages, table


def predict(docs: DataFrame, languages: list[str], table: np.ndarray, vocabulary: str) -> DataFrame:
    """docs with lang_pred and score, both replaced where docs has them, in any case.

    A null text, one without a letter, or a model without languages gives und and 0. Bytes that are no UTF-8 are no letters. Ties go to the language that sorts first. The
    score is the winner's share of the likelihoods after each is raised to one over the root of the number of words, so that long
    texts do not all score 1. The model sent along is bounded by the vocabulary and MOST_LANGUAGES.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(np.vstack([table, np.full((1, len(languages)), UNKNOWN)]))
    most = min(MOST_WORDS, 4_000_000 // max(1, len(languages)))
    rest, back_to = apart(docs, ("text",), ("lang_pred", "score"))

    def score(column: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _pieces(vocabulary)
        # Words are known by their bytes, whole.
        known, values = Known(), np.zeros((0, len(languages) + 1))
        for series in column:
            texts, parts = series.tolist(), []
            for s in slices(texts):
                w = words_of(texts[s])
                distinct, back = w.distinct()
                if len(known) + len(distinct.start) > most or len(known.bytes) > MOST_BYTES:
                    known, values = Known(), values[:0]
                at, hashes = known.find(distinct)
                fresh = np.flatnonzero(at < 0)
                if len(fresh):
                    split = [units(distinct.word(i).decode("utf-8", "replace")) for i in fresh.tolist()]
                    flat = [u for us in split for u in us]
                    new = np.zeros((len(split), len(languages) + 1))
                    if flat:
                        owner = np.repeat(np.arange(len(split)), [len(us) for us in split])
                        each = word_scores(flat, own, sent.value)
                        for k in range(len(languages)):
                            new[:, k] = np.bincount(owner, weights=each[:, k], minlength=len(split))
                        new[:, -1] = np.bincount(owner, minlength=len(split))
                    at[fresh] = np.arange(len(values), len(values) + len(fresh))
                    known.add(distinct, hashes, fresh)
                    values = np.r_[values, new]
                sums = np.vstack([np.zeros((1, len(languages) + 1)), np.cumsum(values[at[back]], axis=0)]) if len(at) else np.zeros((1, len(languages) + 1))
                parts.append(sums[w.first[1:]] - sums[w.first[:-1]])
            total = np.vstack(parts) if parts else np.zeros((0, len(languages) + 1))
            count = np.rint(total[:, -1])
            if not languages:
                yield pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": np.zeros(len(texts))})
                continue
            logs = total[:, :-1] / np.sqrt(np.maximum(count, 1))[:, None]
            share = np.exp(logs - logs.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            best = share.argmax(1)
            none = count == 0
            yield pd.DataFrame({"lang_pred": np.where(none, UNDETERMINED, np.array(languages, dtype=object)[best]), "score": np.where(none, 0.0, share[np.arange(len(best)), best])})
        del known, values
        release()

    run = F.pandas_udf(score, "lang_pred string, score double")
    told = rest.withColumn("__gleaner_language", run(text_bytes()))
    return back_to(told, "__gleaner_language.lang_pred", "__gleaner_language.score")


def held_out() -> Column:
    """True where crc32 of doc_id as text leaves 2 when divided by 4; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs with held_out, lang_pred and score (replaced where docs has them, in any case); learns from the rows that are not held out. No
    columns but doc_id, text and lang are read. Each row is told for itself and by its whole text, however long, so rows that repeat are
    told alike; for null and empty texts and ties see predict, for null languages train. An empty table gives no rows."""
    own, back = apart(docs, ("doc_id", "text", "lang"), ("held_out", "lang_pred", "score"))
    languages, table = train(own.where(~held_out()).select("doc_id", "text", "lang"), vocabulary)
    return back(predict(own.withColumn("held_out", held_out()), languages, table, vocabulary), "held_out", "lang_pred", "score")
