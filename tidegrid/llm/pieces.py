"""SentencePiece models on the tokenizers library.

The model's protobuf is read field by field; normaliser, white space marker, scores and
byte fallback are rebuilt as a ``tokenizers`` pipeline for unigram and BPE models. Batches
are encoded multithreaded and decoded again; the sentencepiece library encodes and decodes
every whole text beside it, and both are compared text by text.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

MARK = "▁"
#: Piece types of the published model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the published model format (fixed values).
UNIGRAM, BPE = 1, 2
RESULT = "doc_id long, n_pieces long, ids_crc32 long, n_byte_pieces long, same_ids boolean, decoded_same boolean, round_trip boolean"


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message: varints as int, others as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buf[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(buf):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, buf[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(buf: bytes) -> Model:
    """Field numbers are those of the published sentencepiece_model.proto (fixed values)."""
    m = Model()
    for n, v in fields(buf):
        if n == 1:
            f = dict(fields(v))
            m.pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif n == 2:
            f = dict(fields(v))
            m.kind, m.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
        elif n == 3:
            f = dict(fields(v))
            m.charsmap, m.dummy_prefix, m.squeeze_spaces, m.escape_spaces = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best piece first: the merges of a BPE model."""
    ids = {p: i for i, (p, _, t) in enumerate(m.pieces) if t in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, i in ids.items():
        for k in range(1, len(p)):
            if p[:k] in ids and p[k:] in ids:
                found.append((-m.pieces[i][1], i, ids[p[:k]], ids[p[k:]], p[:k], p[k:]))
    return [x[-2:] for x in sorted(found)]


def build(m: Model):
    """A ``tokenizers`` pipeline that encodes as the model does."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        t = Tokenizer(models.BPE(vocab, merges_of(m), unk_token=m.pieces[m.unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback))
    elif m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unknown, byte_fallback=m.byte_fallback))
    else:
        raise ValueError("only unigram and BPE models can be rebuilt")
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape_spaces else " "))
    if m.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.add_tokens([AddedToken(p, normalized=True) for p, _, k in m.pieces if k == USER_DEFINED])
    if m.escape_spaces and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in m.pieces):
        # no piece goes on past a word's end, so words are encoded apart
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """A model file as a ``tokenizers`` pipeline, with the sentencepiece library beside it to verify.

    Where no piece goes on past a word's end, ids of a text are the ids of its words in a
    row. Then each distinct word is encoded and decoded once, many words to a text; texts
    with runs of spaces or a literal marker go through whole.
    """

    #: Words that are kept: so many, and up to so many characters, as longer ones seldom recur; words to a text.
    limit, longest, joined = 800_000, 12, 256

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.model = parse(f.read())
        self.path, self.loaded = path, None
        self.tokenizer = build(self.model)
        self.by_word = self.tokenizer.pre_tokenizer is not None and self.model.dummy_prefix and not self.model.squeeze_spaces and not self.model.charsmap
        self.starts = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.is_byte = np.array([k == BYTE for _, _, k in self.model.pieces])
        self.known: dict[str, bytes] = {}
        self.other: dict[str, str] = {}  # words that decode to another text, and that text

    @property
    def library(self):
        if self.loaded is None:
            import sentencepiece

            self.loaded = sentencepiece.SentencePieceProcessor(model_file=self.path)
        return self.loaded

    def whole(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Ids and decoded text of each text; the batch runs on several threads whatever other operators set in this worker."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        decoded = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(np.array(a, "<u4").tobytes(), d) for a, d in zip(ids, decoded, strict=True)]

    def learn(self, words: list[str]) -> None:
        """Encode and decode words that aren't known yet."""
        groups = [words[i : i + self.joined] for i in range(0, len(words), self.joined)]
        texts = [" ".join(g) for g in groups]
        for group, text, (raw, decoded) in zip(groups, texts, self.whole(texts), strict=True):
            at = (np.flatnonzero(self.starts[np.frombuffer(raw, "<u4")]) * 4).tolist()
            if decoded == text and len(at) == len(group):
                self.known.update(zip(group, (raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)), strict=True))
                continue
            for w, (ids, back) in zip(group, self.whole(group), strict=True):
                self.known[w] = ids
                if back != w:
                    self.other[w] = back

    def coded(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """The ids of each text, and what they decode to."""
        if not self.by_word:
            return self.whole(texts)
        if len(self.known) > self.limit:
            self.known, self.other = {}, {}
        cut = [t.split(" ") if t else [] for t in texts]
        apart = [i for i, words in enumerate(cut) if "" in words or MARK in texts[i]]
        for i in apart:
            cut[i] = []
        fresh = list(set().union(*cut).difference(self.known))
        self.learn(fresh)
        out = []
        for text, words in zip(texts, cut, strict=True):
            back = " ".join([self.other.get(w, w) for w in words]) if self.other and not self.other.keys().isdisjoint(words) else text
            out.append((b"".join(map(self.known.__getitem__, words)), back))
        for i, found in zip(apart, self.whole([texts[i] for i in apart]), strict=True):
            out[i] = found
        for w in fresh:
            if len(w) > self.longest:
                del self.known[w]
                self.other.pop(w, None)
        return out

    def verified(self, texts: list[str]) -> list[tuple[bytes, bool, bool, bool]]:
        """Per text: ids, whether the library's ids and its decoding are the same, and whether decoding returns the text."""
        theirs = self.library.encode(texts, num_threads=1)
        back = self.library.decode(theirs)
        return [(raw, raw == np.array(ids, "<u4").tobytes(), decoded == b, decoded == t) for (raw, decoded), ids, b, t in zip(self.coded(texts), theirs, back, texts, strict=True)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the piece ids of every text; a null or empty text has none.

    Repeated rows are encoded apart; an empty table gives no row; further columns are ignored.
    """
    shared.share_code(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                yield pd.DataFrame({"doc_id": some["doc_id"], "ids": [np.frombuffer(raw, "<u4").astype(np.int32) for raw, _ in c.coded(some["text"].tolist())]})

    rows = docs.select(shared.id_in(), F.coalesce("text", F.lit("")).alias("text"))
    return shared.id_out(rows.mapInPandas(run, "doc_id long, ids array<int>"))


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of piece ids; null ids give an empty text.

    Repeated rows are decoded each, a very long list whole; a null doc_id stays null; further
    columns are ignored; an empty table gives no row.
    """
    shared.share_code(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = codec(model).tokenizer
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "text": t.decode_batch([[] if x is None else list(map(int, x)) for x in pdf["ids"]], skip_special_tokens=False)})

    return shared.id_out(encoded.select(shared.id_in(), "ids").mapInPandas(run, "doc_id long, text string"))


def verify_pieces(docs: DataFrame, model: str) -> DataFrame:
    """Per document: its encoding, whether the sentencepiece library gives the same ids, and whether decoding returns the text.

    Nulls are empty texts; repeated rows are encoded each, a very long text whole; further
    columns are ignored; an empty table gives no row. The library encodes and decodes each whole text:
    ``same_ids`` compares its ids, ``decoded_same`` its decoding, ``round_trip`` the text itself.
    """
    shared.share_code(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at : at + 512]
                found = c.verified(some["text"].tolist())
                yield pd.DataFrame(
                    {
                        "doc_id": some["doc_id"],
                        "n_pieces": [len(x[0]) // 4 for x in found],
                        "ids_crc32": [zlib.crc32(x[0]) for x in found],
                        "n_byte_pieces": [int(c.is_byte[np.frombuffer(x[0], "<u4")].sum()) for x in found],
                        "same_ids": [x[1] for x in found],
                        "decoded_same": [x[2] for x in found],
                        "round_trip": [x[3] for x in found],
                    }
                )

    rows = docs.select(shared.id_in(), F.coalesce("text", F.lit("")).alias("text"))
    return shared.id_out(rows.mapInPandas(run, RESULT))
