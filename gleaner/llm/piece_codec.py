"""SentencePiece encoding and decoding by the tokenizers library.

The model file is parsed here; from its settings a tokenizer is built again: normaliser, word mark, unigram scores or merges in the
order of their scores, byte fallback, and the decoder. Where no piece has the mark after another character, a text is the sequence of its
units (spaces and what follows up to the next one), and each distinct unit is encoded once for a worker, in batches on the task's own thread.
A text that holds the mark itself is encoded whole, as the mark counts for a space there. Decoding is the library's, text by text.

Parity: each new unit's ids, and those of each text that is encoded whole, are held against the sentencepiece library's; the texts that
differ are told by a column.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.coder import UnitCoder
from gleaner.llm.common import apart, small_batches, text_bytes
from gleaner.llm.held import held, release
from gleaner.llm.piece_model import BPE, NORMAL, SPACE, UNIGRAM, UNKNOWN, USER_DEFINED, PieceModel, load
from gleaner.llm.words import Words, slices


def build(model: PieceModel, whole: bool = True):
    """A tokenizers.Tokenizer for a unigram or BPE model: of whole texts, or of units, which have no dummy prefix to come."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if not model.escape_whitespaces:
        raise ValueError("models that keep white space as it is are not supported")
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        scored = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for piece, score in scored.items():
            parts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in scored and piece[i:] in scored]
            merges += [(-score, vocab[piece], vocab[a], vocab[b], a, b) for a, b in parts]
        core = models.BPE(vocab, [(a, b) for *_, a, b in sorted(merges)], unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind}")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(SPACE)] if model.add_dummy_prefix and whole else []
    tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", SPACE)])
    if splits(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"), "isolated")
    last = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(SPACE, " "), decoders.ByteFallback(), decoders.Fuse(), *last])
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def splits(model: PieceModel) -> bool:
    """Whether no piece reaches over the start of a unit."""
    return not any(SPACE in p.lstrip(SPACE) for p, _, kind in model.pieces if kind in (NORMAL, USER_DEFINED))


def plain(model: PieceModel) -> bool:
    """Whether a text's normal form is the text with its dummy prefix, so that units can be cut from its bytes."""
    return splits(model) and model.add_dummy_prefix and not (model.charsmap or model.remove_extra_whitespaces) and not any(kind == USER_DEFINED for *_, kind in model.pieces)


def units_of(texts: list[bytes]) -> Words:
    """Each text with a space before it, cut before each run of spaces. An empty text has no unit."""
    sizes = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
    buffer = np.frombuffer(b"".join(b" " + t for t in texts if t), dtype=np.uint8)
    space = buffer == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    ends = np.cumsum(sizes)
    starts[(ends - sizes)[sizes > 0]] = True
    start = np.flatnonzero(starts)
    end = np.r_[start[1:], len(buffer)] if len(start) else start
    first = np.r_[0, np.searchsorted(start, ends)].astype(np.int64)
    return Words(buffer, start, end, first)


class Codec:
    """Encodes and decodes whole texts with a model file. verify: "units" holds each new unit, and each text that is encoded whole,
    against the sentencepiece library; "texts" every whole text; None nothing."""

    def __init__(self, path: str, verify: str | None = "units"):
        import sentencepiece

        if verify not in ("units", "texts", None):
            raise ValueError(f"verify: {verify!r}")
        # A task has one core, and each further thread of the library keeps memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.verify = load(path), verify
        self.whole = build(self.model)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path) if verify else None
        self.cut = plain(self.model)
        if self.cut:
            self.own = build(self.model, whole=False)
            self.units = UnitCoder(self._encode_units)
            self.differ: set[str] = set()

    def _encode_units(self, units: list[str]) -> list[list[int]]:
        ids = [e.ids for e in self.own.encode_batch_fast(units, add_special_tokens=False)]
        if self.verify == "units":
            # A unit is a text's start without its dummy space; a lone space is one that no text starts with.
            theirs = self.reference.encode([u[1:] for u in units], num_threads=1)
            self.differ.update(u for u, a, b in zip(units, ids, theirs) if a != b and u != " ")
        return ids

    def _encode_whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        return ids, self._same(texts, ids) if self.verify else [True] * len(texts)

    def _same(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        return [a == b for a, b in zip(ids, self.reference.encode(texts, num_threads=1))]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each text has, and whether they are those of the sentencepiece library."""
        by_hand = [i for i, t in enumerate(texts) if not self.cut or MARK in t]
        parity = np.ones(len(texts), dtype=bool)
        if self.cut:
            rest = list(texts)
            for i in by_hand:
                rest[i] = b""
            found = units_of(rest)
            flat, n = self.units(found)
            if self.differ:
                odd = np.fromiter((found.word(i).decode("utf-8", "replace") in self.differ for i in range(len(found.start))), dtype=bool, count=len(found.start))
                sums = np.r_[0, np.cumsum(odd)]
                parity &= sums[found.first[1:]] == sums[found.first[:-1]]
            if self.verify == "texts":
                parity &= self._same([t.decode("utf-8", "replace") for t in rest], [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]) if len(rest) else parity
        else:
            flat, n = np.zeros(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        if by_hand:
            ids, same = self._encode_whole([texts[i].decode("utf-8", "replace") for i in by_hand])
            parity[by_hand] = same
            at = (np.cumsum(n) - n)[by_hand]
            flat = np.insert(flat, np.repeat(at, [len(x) for x in ids]), np.array([i for x in ids for i in x], dtype=np.uint32))
            n = n.copy()
            n[by_hand] = [len(x) for x in ids]
        return flat, n, parity

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids, by the tokenizers library."""
        ends = np.cumsum(counts)
        flat = ids.tolist()
        return self.whole.decode_batch([flat[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())], skip_special_tokens=False)


_CODED = [T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())]
MARK = SPACE.encode()


def codec(path: str, verify: str | None = "units") -> Codec:
    return held(("piece codec", path, verify), lambda: Codec(path, verify))


def encode(docs: DataFrame, path: str, verify: str | None = "units", strict: bool = False) -> DataFrame:
    """docs without text, with piece_ids, n_pieces, round_trip (whether the ids decode to exactly the text) and parity (whether they are
    those of the sentencepiece library; see Codec for verify).

    A null or empty text has no ids, and decodes to the empty text. Bytes that are no UTF-8 are encoded as U+FFFD, a literal word mark as
    a space: such texts have no round trip. Texts are encoded whole, however long, and rows that repeat alike; an empty table gives no
    rows. Columns of those four names, in any case, are replaced; all others and all rows stay. strict: a text without parity fails the task.
    """
    small_batches(docs.sparkSession)
    coded = [f.name for f in _CODED]
    own_docs, _ = apart(docs, ("text",))
    at = [i for i, (c, n) in enumerate(zip(docs.columns, own_docs.columns)) if n != "text" and c.lower() not in coded]
    kept = [own_docs.columns[i] for i in at]
    rows = own_docs.select(*kept, text_bytes().alias("text"))
    schema = T.StructType([*own_docs.select(*kept).schema.fields, *_CODED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, verify)
        for batch in batches:
            texts = batch.column(len(kept)).to_pylist()
            for s in slices(texts):
                flat, n, parity = own.encode(texts[s])
                if strict and not parity.all():
                    raise AssertionError(f"parity: {texts[s][int(np.flatnonzero(~parity)[0])][:200]!r}")
                same = [a.encode("utf-8", "surrogatepass") == b for a, b in zip(own.decode(flat, n), texts[s])]
                ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(flat.astype(np.int32)))
                own_rows = batch.slice(s.start, s.stop - s.start).columns[: len(kept)]
                yield pa.RecordBatch.from_arrays([*own_rows, ids, pa.array(n, pa.int64()), pa.array(same, pa.bool_()), pa.array(parity, pa.bool_())], schema.fieldNames())
        release()

    return rows.mapInArrow(run, schema).toDF(*[docs.columns[i] for i in at], *coded)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """rows with text from their piece_ids; null ids give a null text. All other columns and rows stay."""

    def run(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path, None)
        for series in column:
            counts = np.array([0 if x is None else len(x) for x in series], dtype=np.int64)
            flat = np.array([i for x in series if x is not None for i in x], dtype=np.int64)
            yield pd.Series([None if x is None else t for x, t in zip(series, own.decode(flat, counts))], dtype=object)

    return rows.withColumn("text", F.pandas_udf(run, "string")("piece_ids"))
