"""Removal of words in windows that occur earlier in the corpus, by recompression.

1. Reveal. Rounds of run and pair naming (``recompression``) give each window of
   ``window`` words a core, a symbol of some five words that all equal windows share.
   The windows around one core occurrence form a context. Contexts are dealt by the name
   of their core: one whose core occurs nowhere else is done. Of contexts that agree in
   core and in a digest of their words, all but the first are covered as a whole.
2. Verify. The windows of the other contexts, different ones around one core, are dealt
   by a 128-bit digest of their words; all but the first of a window are covered.
3. Each document drops its covered words.

Rows move as packed arrays. A task sends a context or a window at most once, so copies in
a third of all documents cost each task one entry. A core with over ``hot`` different
contexts in one task is known to be shared: its contexts are dealt by their own digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .recompression import cores

U64 = np.uint64
CONTEXT = np.dtype([("name", "<u8"), ("check", "<u8"), ("doc", "<i8"), ("version", "<i8"), ("start", "<u4"), ("more", "u1"), ("kind", "u1")])
OWN, SHARED, MARK = 0, 1, 2  # dealt by core; by digest, as its core is shared; no context, says that its core is shared
PLACE = ("doc", "version", "start")
KEY = ["doc_id", "version"]
RANGES = "doc_id long, version long, start int, size int, left boolean"


def pack(e: np.ndarray) -> bytes:
    """Entries byte by byte of their fields, so that zero bytes lie together."""
    return np.ascontiguousarray(e.view(np.uint8).reshape(len(e), -1).T).tobytes()


def unpack(blob: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(kind.itemsize, -1).T).view(kind)[:, 0]


def packed_by(e: np.ndarray, part: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    return [(p, pack(e[order[cuts[p] : cuts[p + 1]]])) for p in range(parts) if cuts[p + 1] > cuts[p]]


def _new(e: np.ndarray, *fields: str) -> np.ndarray:
    """True where sorted entries differ from the one before."""
    out = np.zeros(len(e), bool)
    out[:1] = True
    for f in fields:
        out[1:] |= e[f][1:] != e[f][:-1]
    return out


def folded(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted entries; which are the first of their name and digest; which lie after that one.

    An entry at the first one's own place, of a repeated row, is neither.
    """
    e = e[np.lexsort((e["start"], e["version"], e["doc"], e["check"], e["name"]))]
    first = _new(e, "name", "check")
    head = np.maximum.accumulate(np.where(first, np.arange(len(e)), 0))
    later = np.zeros(len(e), bool)
    for f in PLACE:
        later |= e[f] != e[f][head]
    return e, first, later


class Pieces:
    """Words of some documents in a row: their hashes, and their bytes with one space between."""

    def __init__(self) -> None:
        self.words: list[bytes] = []
        self.owners: list[tuple[int, int, int, int]] = []  # doc, version, first word's number, words

    def add(self, doc: int, version: int, at: int, words: list[bytes]) -> None:
        self.words += words
        self.owners.append((doc, version, at, len(words)))

    def contexts(self, window: int) -> np.ndarray:
        names = np.fromiter(map(shared._hashes.__getitem__, self.words), U64, len(self.words))
        doc, version, offset, size = (np.array(c, np.int64) for c in zip(*self.owners, strict=True))
        bounds = np.append(0, np.cumsum(size))
        at, core, place = cores(names, bounds, window)
        begins = np.ones(len(at), bool)
        begins[1:] = (core[1:] != core[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        heads = np.flatnonzero(begins)
        start, more = at[heads], np.diff(np.append(heads, len(at))) - 1
        raw = b" ".join(self.words)
        lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        byte = np.append(0, np.cumsum(lengths + 1))
        digest = xxhash.xxh3_64_intdigest
        e = np.zeros(len(heads), CONTEXT)
        e["check"] = np.fromiter((digest(raw[a:b]) for a, b in zip(byte[start].tolist(), (byte[start + more + window] - 1).tolist(), strict=True)), U64, len(heads))
        owner = np.searchsorted(bounds, start, "right") - 1
        e["name"], e["doc"], e["version"], e["more"] = core[heads], doc[owner], version[owner], more
        e["start"] = start - bounds[owner] + offset[owner]
        return e


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def _contexts(batches: Iterator[pd.DataFrame], window: int, parts: int, chunk: int, hot: int, step: int = 1 << 18) -> Iterator[pd.DataFrame]:
    """Packed contexts by part, of about ``chunk`` words at a time; what is covered already has part -1."""

    def settle(found: list[np.ndarray]) -> pd.DataFrame:
        e, first, later = folded(np.concatenate(found))
        rows = [(-1, pack(e[later]))] if later.any() else []
        e = e[first]
        head = np.flatnonzero(_new(e, "name"))
        size = np.diff(np.append(head, len(e)))
        e["kind"][np.repeat(size > hot, size)] = SHARED
        marks = np.zeros(int((size > hot).sum()), CONTEXT)
        marks["name"], marks["kind"] = e["name"][head[size > hot]], MARK
        e = np.concatenate([e, marks])
        return pd.DataFrame(rows + packed_by(e, (np.where(e["kind"] == SHARED, e["check"], e["name"]) % U64(parts)).astype(np.int64), parts), columns=["part", "blob"])

    held, found, total = Pieces(), [], 0
    for pdf in batches:
        for doc, version, text in zip(pdf["doc_id"], pdf["version"], pdf["text"], strict=True):
            words = split_words(text)
            for at in range(0, len(words) - window + 1, step):  # a longer text goes on in pieces: a core depends on its window alone
                held.add(doc, version, at, words[at : at + step + window - 1])
                if len(held.words) >= step:
                    found.append(held.contexts(window))
                    total += len(held.words)
                    held = Pieces()
                if total >= chunk:
                    yield settle(found)
                    found, total = [], 0
    if held.words:
        found.append(held.contexts(window))
    if found:
        yield settle(found)


def _frame(e: np.ndarray, window: int, left: bool) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": e["doc"], "version": e["version"], "start": e["start"].astype(np.int32), "size": e["more"].astype(np.int32) + window, "left": left})


def _gathered(batches: Iterator[pd.DataFrame], kind: np.dtype) -> tuple[list[np.ndarray], np.ndarray | None]:
    """Covered entries as they came, and all others."""
    covered, rest = [], []
    for pdf in batches:
        for part, blob in zip(pdf["part"], pdf["blob"], strict=True):
            (covered if part < 0 else rest).append(unpack(blob, kind))
    return covered, np.concatenate(rest) if rest else None


def _revealed(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Ranges of contexts: covered ones, and those to be verified window by window (left)."""
    covered, e = _gathered(batches, CONTEXT)
    for done in covered:
        yield _frame(done, window, False)
    if e is None:
        return
    e, first, later = folded(e)
    if later.any():
        yield _frame(e[later], window, False)
    e = e[first]
    head = np.flatnonzero(_new(e, "name"))
    size = np.diff(np.append(head, len(e)))
    shared_core = np.repeat((size > 1) | (np.maximum.reduceat(e["kind"], head) > OWN), size)
    left = shared_core & (e["kind"] != MARK)
    if left.any():
        yield _frame(e[left], window, True)


def _windows(batches: Iterator[pd.DataFrame], window: int, parts: int, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Packed windows by part of their digest, ``most`` at a time; what is covered already has part -1."""
    digest = xxhash.xxh3_128_digest
    marks: list[bytes] = []
    owners: list[tuple[int, int]] = []
    places: list[np.ndarray] = []

    def settle() -> pd.DataFrame:
        e = np.zeros(len(marks), CONTEXT)
        both = np.frombuffer(b"".join(marks), "<u8").reshape(-1, 2)
        e["name"], e["check"] = both[:, 0], both[:, 1]
        sizes = [len(p) for p in places]
        e["doc"], e["version"] = np.repeat(np.array([o[0] for o in owners], np.int64), sizes), np.repeat(np.array([o[1] for o in owners], np.int64), sizes)
        e["start"] = np.concatenate(places)
        e, first, later = folded(e)
        rows = [(-1, pack(e[later]))] if later.any() else []
        e = e[first]
        return pd.DataFrame(rows + packed_by(e, (e["name"] % U64(parts)).astype(np.int64), parts), columns=["part", "blob"])

    for pdf in batches:
        for doc, version, text, cuts in zip(pdf["doc_id"], pdf["version"], pdf["text"], pdf["cuts"], strict=True):
            words = split_words(text)
            raw = b" ".join(words)
            byte = np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
            at = np.concatenate([np.arange(c["start"], c["start"] + c["size"] - window + 1) for c in cuts])
            for i in range(0, len(at), most):
                some = at[i : i + most]
                marks += [digest(raw[a:b]) for a, b in zip(byte[some].tolist(), (byte[some + window] - 1).tolist(), strict=True)]
                owners.append((doc, version))
                places.append(some)
                if len(marks) >= most:
                    yield settle()
                    marks, owners, places = [], [], []
    if marks:
        yield settle()


def _verified(batches: Iterator[pd.DataFrame], window: int) -> Iterator[pd.DataFrame]:
    """Ranges of windows that occur earlier; windows at neighbouring places are one range."""

    def ranges(e: np.ndarray) -> pd.DataFrame:
        e = e[np.lexsort((e["start"], e["version"], e["doc"]))]
        head = np.ones(len(e), bool)
        head[1:] = (e["doc"][1:] != e["doc"][:-1]) | (e["version"][1:] != e["version"][:-1]) | (e["start"][1:] - e["start"][:-1] > 1)
        at = np.flatnonzero(head)
        last = np.append(at[1:], len(e)) - 1
        return pd.DataFrame({"doc_id": e["doc"][at], "version": e["version"][at], "start": e["start"][at].astype(np.int32), "size": (e["start"][last].astype(np.int64) - e["start"][at] + window).astype(np.int32), "left": False})

    covered, e = _gathered(batches, CONTEXT)
    for done in covered:
        yield ranges(done)
    if e is not None:
        e, _, later = folded(e)
        if later.any():
            yield ranges(e[later])


def _dealt(packed: DataFrame, n: int) -> DataFrame:
    """Packed entries to the task of their part; what is covered already to any."""
    return packed.repartition(n, F.when(F.col("part") < 0, F.xxhash64("blob")).otherwise(F.col("part").cast("long")))


def versions(docs: DataFrame, most: int = 100_000) -> DataFrame:
    """(doc_id, version, row): version is 0, or a hash of the text where a doc_id repeats; row is the whole row.

    Up to ``most`` repeated ids are broadcast, more are joined.
    """
    rows = docs.select(shared.id_in(), F.struct(*docs.columns).alias("row"))
    repeated = shared.stored(rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    n = repeated.count()
    version = F.lit(0).cast("long")
    if n:
        rows = rows.join(F.broadcast(repeated) if n <= most else repeated, "doc_id", "left")
        version = F.when(F.col("again"), F.xxhash64(F.coalesce("row.text", F.lit("")))).otherwise(version)
    return rows.select("doc_id", version.alias("version"), "row")


def covered_words(texts: DataFrame, window: int = 20, hot: int = 16, chunk: int = 1 << 21) -> DataFrame:
    """(doc_id, version, start, size) in words of ranges that consist of earlier seen windows; they may overlap.

    ``texts`` has doc_id, version and text, without nulls.
    """
    if not 8 <= window <= 200:
        raise ValueError("windows of 8 to 200 words are supported")
    n = shared.shuffle_partitions(texts.sparkSession)
    parts = 4 * n
    chunk = max(chunk, min(1 << 24, parts << 12))
    found = texts.mapInPandas(lambda b: _contexts(b, window, parts, chunk, hot), "part int, blob binary")
    known = shared.stored(_dealt(found, n).mapInPandas(lambda b: _revealed(b, window), RANGES), "contexts")
    wanted = known.filter("left").groupBy(*KEY).agg(F.collect_list(F.struct("start", "size")).alias("cuts"))
    cut = texts.join(wanted, KEY).mapInPandas(lambda b: _windows(b, window, parts), "part int, blob binary")
    verified = _dealt(cut, n).mapInPandas(lambda b: _verified(b, window), RANGES)
    return known.filter("not left").union(verified).drop("left")


def kept_words(words: list[bytes], starts: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    if starts is None or not len(starts):
        return words
    edge = np.zeros(len(words) + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + sizes, len(words)), -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _with_ranges(docs: DataFrame, window: int, options: dict) -> DataFrame:
    """The rows of ``versions`` with text and the starts and sizes of their covered ranges, null where a document has none."""
    shared.share_code(docs.sparkSession)
    keyed = versions(docs)
    text = F.coalesce("row.text", F.lit("")).alias("text")
    ranges = covered_words(keyed.select(*KEY, text), window, **options).groupBy(*KEY).agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    return keyed.select(*KEY, text, "row").join(ranges, KEY, "left")


def substring_duplicates(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """Per document: n_words, n_removed and the digest of the kept words with one space between.

    A word goes if a window of ``window`` words over it also starts earlier: in a document
    of smaller doc_id, or earlier in the same one. Windows are those of the input; a text of
    fewer words loses none. A null text has no words; a null doc_id counts as smallest.
    Rows of one doc_id with the same text are one document and don't remove each other's
    words, others are ordered by a hash of their text. A very long text goes through the
    rounds in pieces that overlap by a window. An empty table gives no row; further
    columns are ignored.
    """

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, starts, sizes in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["sizes"], strict=True):
                words = split_words(text)
                kept = kept_words(words, starts, sizes)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_ranges(docs.select("doc_id", "text"), window, options).select("doc_id", "text", "starts", "sizes")
    return shared.id_out(rows.mapInPandas(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def without_repeated_windows(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """The documents, all columns, with words in repeated windows cut from ``text`` and one space between those kept.

    A text that loses no word stays as it is, a null text null. Nulls, repeated rows and
    long texts are treated as in ``substring_duplicates``; columns of any name pass.
    """

    @F.pandas_udf("string")
    def cut(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = [t if t is None or a is None else b" ".join(kept_words(split_words(t), a, s)).decode("utf-8", "surrogatepass") for t, a, s in zip(texts, starts, sizes, strict=True)]
        return pd.Series(out, index=texts.index, dtype=object)

    return _with_ranges(docs, window, options).select(F.col("row").withField("text", cut("row.text", "starts", "sizes")).alias("row")).select("row.*")
