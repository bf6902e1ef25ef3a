"""Removal of bytes in strings that occur earlier in the corpus, by suffix grouping.

Equal strings of ``length`` bytes hold the same anchor: the leftmost least hash of the
32-byte grams in them. The strings with one anchor occurrence form a context, at most
168 bytes for strings of 100, and only contexts around the same gram can share strings.

1. Contexts are dealt by their gram. A gram that occurs once is done. Of identical
   contexts only the first can hold a first occurrence; all others are covered whole.
2. The remaining different contexts around a gram, mostly the edges of copied passages,
   are cut from the texts, and a task's contexts are sorted together by linear suffix
   grouping (``suffix_order``), eight bytes a symbol in step with the anchor. Suffixes
   that share eleven symbols, with the same twelve bytes at the edges, are the same
   string: the first in corpus order stays, the others are covered.
3. Each document drops its covered bytes.

Rows move as packed arrays, at most one context a gram and batch for identical ones, so
a passage in a third of all documents costs each task one entry. Where a gram has over
``hot_contexts`` different contexts, these are dealt by the 88 bytes around which their
strings lie, and where those are as frequent, string by string: each level is settled by
suffix grouping within batches first, so what is dealt are different strings.
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
from .suffix_order import suffix_array

U64 = np.uint64
GRAM, CORE = 32, 88
_MULTIPLIER = 0x9E3779B97F4A7C15
ENTRY = [("gram", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("anchor", "u1"), ("more", "u1")]


def _grams(a: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of all windows of each size, powers of two in ascending order."""
    h, p, n, out = a.astype(U64) + U64(1), _MULTIPLIER, 1, []
    while True:
        if n in sizes:
            out.append(shared.mix64(h))
        if n == sizes[-1]:
            return out
        h = h[:-n] * U64(p) + h[n:]
        p, n = p * p % 2**64, 2 * n


def contexts(raw: bytes, bounds: np.ndarray, length: int = 100) -> dict[str, np.ndarray]:
    """The contexts of all strings of ``length`` bytes inside the documents ``raw[bounds[i]:bounds[i + 1]]``.

    start is the first string's place in ``raw``, more the number of strings less one,
    anchor the gram's offset from start.
    """
    a = np.frombuffer(raw, np.uint8)
    m, w = len(a) - length + 1, length - GRAM + 1
    none = {k: np.zeros(0, np.int64) for k in ("start", "more", "anchor")} | {k: np.zeros(0, U64) for k in ("gram", "context")}
    if m <= 0:
        return none
    h, wide = _grams(a, (GRAM, 2 * GRAM))
    least, n = h, 1
    while 2 * n <= w:
        least, n = np.minimum(least[:-n], least[n:]), 2 * n
    least = np.minimum(least[: m], least[w - n :][: m])
    crossing = np.zeros(len(a) + 1, np.int32)
    np.add.at(crossing, np.maximum(bounds[:-1], bounds[1:] - length + 1), 1)
    np.add.at(crossing, bounds[1:], -1)
    inside = np.cumsum(crossing)[:m] == 0
    start = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])]))
    end = np.append(start[1:], m) - 1
    start, end = start[inside[start]], end[inside[start]]
    if not len(start):
        return none
    at = np.empty(len(start), np.int64)
    steps = np.arange(w)
    for i in range(0, len(start), 16384):
        some = start[i : i + 16384]
        at[i : i + 16384] = some + (h[some[:, None] + steps] == least[some][:, None]).argmax(1)
    tied = np.flatnonzero(end > at)  # the same gram again within reach: each place is an anchor of its own
    if len(tied):
        parts = []
        for i in tied:
            places = start[i] + np.flatnonzero(h[start[i] : end[i] + w] == least[start[i]])
            stop = np.minimum(places[: np.searchsorted(places, end[i]) + 1], end[i])
            parts.append((np.append(start[i], stop[:-1] + 1), stop, places[: len(stop)]))
        keep = np.ones(len(start), bool)
        keep[tied] = False
        start, end, at = (np.concatenate([old[keep], *(p[k] for p in parts)]) for k, old in enumerate((start, end, at)))
    mixed = wide[start] * U64(3) ^ wide[start + length - 64] * U64(5) ^ wide[end] * U64(7) ^ wide[end + length - 64] * U64(11)
    return {"start": start, "more": end - start, "anchor": at - start, "gram": least[start], "context": shared.mix64(mixed + (end - start).astype(U64))}


def _pack(e: np.ndarray) -> bytes:
    """Entries column by column and byte by byte, so that zero bytes lie together."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(e[k]).view(np.uint8).reshape(len(e), -1).T).tobytes() for k, _ in ENTRY)


def _unpack(blob: bytes) -> np.ndarray:
    widths = [np.dtype(t).itemsize for _, t in ENTRY]
    n = len(blob) // sum(widths)
    out, at = np.empty(n, ENTRY), 0
    for (k, t), width in zip(ENTRY, widths, strict=True):
        out[k] = np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * width, at).reshape(width, n).T).view(t)[:, 0]
        at += n * width
    return out


def _new(*arrays: np.ndarray) -> np.ndarray:
    """True where sorted rows differ from the row before."""
    out = np.zeros(len(arrays[0]), bool)
    out[:1] = True
    for a in arrays:
        out[1:] |= a[1:] != a[:-1]
    return out


def _firsts(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by gram, context and place; where a context begins; where a gram begins."""
    e = e[np.lexsort((e["start"], e["doc"], e["context"], e["gram"]))]
    gram = _new(e["gram"])
    return e, gram | _new(e["context"]), gram


def _entries(batches: Iterator[pd.DataFrame], length: int, parts: int, chunk: int, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """Packed entries by part of the gram, of about ``chunk`` bytes of text at a time; ranges already known to be covered have part -1."""
    step = min(chunk, most)

    def entries(pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
        docs, offsets, texts = zip(*pieces, strict=True)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        c = contexts(b"".join(texts), bounds, length)
        owner = np.searchsorted(bounds, c["start"], "right") - 1
        e = np.empty(len(owner), ENTRY)
        e["gram"], e["context"], e["anchor"], e["more"] = c["gram"], c["context"], c["anchor"], c["more"]
        e["doc"] = np.array(docs, np.int64)[owner]
        e["start"] = c["start"] - bounds[owner] + np.array(offsets, np.int64)[owner]
        return e

    def settle(found: list[np.ndarray]) -> pd.DataFrame:
        e = np.concatenate(found)
        e, first, _ = _firsts(e)
        rows = [(-1, _pack(e[~first]))] if not first.all() else []
        e = e[first]
        part = (e["gram"] % U64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows += [(p, _pack(e[order[cuts[p] : cuts[p + 1]]])) for p in range(parts) if cuts[p + 1] > cuts[p]]
        return pd.DataFrame(rows, columns=["part", "blob"])

    held, size, found, total = [], 0, [], 0
    for pdf in batches:
        for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, max(1, len(raw) - length + 1), step):  # a longer text goes on in pieces; no string is lost or seen twice
                piece = raw[at : at + step + length - 1]
                if len(piece) >= length:
                    held.append((doc, at, piece))
                    size += len(piece)
                if size >= step:
                    found.append(entries(held))
                    held, size, total = [], 0, total + size
                if total >= chunk:
                    yield settle(found)
                    found, total = [], 0
    if held:
        found.append(entries(held))
    if found:
        yield settle(found)


RANGES = "doc_id long, start int, size int, anchor int, gram long, hot boolean"


def _frame(e: np.ndarray, length: int, kind: int, hot: np.ndarray | None = None) -> pd.DataFrame:
    """Ranges of entries; kind 0 is covered, kind 1 has to be compared."""
    out = pd.DataFrame({"doc_id": e["doc"], "start": e["start"].astype(np.int32), "size": e["more"].astype(np.int32) + length, "anchor": e["anchor"].astype(np.int32)})
    out["gram"] = e["gram"].view(np.int64) if kind else None
    out["hot"] = hot if kind else None
    return out


def _resolve(batches: Iterator[pd.DataFrame], length: int, hot_contexts: int) -> Iterator[pd.DataFrame]:
    blobs: list[np.ndarray] = []
    for pdf in batches:
        for part, blob in zip(pdf["part"], pdf["blob"], strict=True):
            if part < 0:
                yield _frame(_unpack(blob), length, 0)
            else:
                blobs.append(_unpack(blob))
    if not blobs:
        return
    e, first, gram = _firsts(np.concatenate(blobs))
    blobs.clear()
    if not first.all():
        yield _frame(e[~first], length, 0)
    many = np.bincount(np.cumsum(gram) - 1, weights=first)[np.cumsum(gram) - 1]
    left = first & (many > 1)
    if left.any():
        yield _frame(e[left], length, 1, many[left] > hot_contexts)


def _strings(e: pd.DataFrame, length: int) -> pd.DataFrame:
    """The covered ranges of a task's different contexts, whose bytes are in column raw."""
    n = len(e)
    sizes = e["raw"].str.len().to_numpy()
    text = np.frombuffer(b"".join(e["raw"]) + bytes(8), np.uint8)
    base = np.cumsum(sizes) - sizes
    phase = e["anchor"].to_numpy() % 8
    count = (sizes - phase) // 8
    symbol_at = np.cumsum(count + 1) - (count + 1)  # one separator after each context
    owner = np.repeat(np.arange(n), count)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    byte_at = base[owner] + phase[owner] + 8 * block
    words = np.ascontiguousarray(text[byte_at[:, None] + np.arange(8)]).view(">u8")[:, 0]
    names = np.unique(words, return_inverse=True)[1]
    symbols = np.zeros(int((count + 1).sum()), np.int64)
    slots = symbol_at[owner] + block
    symbols[slots] = names + 1
    back = np.full(len(symbols), -1)
    back[slots] = np.arange(len(owner))
    core = CORE // 8
    suffixes = suffix_array(symbols)
    row = back[suffixes]
    suffixes, row = suffixes[row >= 0], row[row >= 0]
    fits = count[owner[row]] - block[row] >= core
    suffixes, row = suffixes[fits], row[fits]
    same = np.ones(max(0, len(suffixes) - 1), bool)
    for k in range(core):
        same &= symbols[suffixes[1:] + k] == symbols[suffixes[:-1] + k]
    run = np.cumsum(np.concatenate([[True], ~same])) if len(suffixes) else np.zeros(0, np.int64)
    often = np.bincount(run)[run] > 1 if len(run) else np.zeros(0, bool)
    row, run = row[often], run[often]
    if not len(row):
        return pd.DataFrame({"doc_id": [], "start": [], "size": []})
    # the strings around each core: e bytes before it, the rest after it
    ctx = np.repeat(owner[row], 8)
    before = np.tile(np.arange(8), len(row))
    begin = np.repeat(byte_at[row], 8) - before - base[ctx]
    ok = (begin >= 0) & (begin + length <= sizes[ctx])
    ctx, before, begin, run = ctx[ok], before[ok], begin[ok], np.repeat(run, 8)[ok]
    edge = length - CORE
    k = np.arange(edge)
    at = (base[ctx] + begin)[:, None] + np.where(k[None] < before[:, None], k[None], k[None] + CORE)
    edges = text[at]
    left = np.ascontiguousarray(edges[:, :8]).view(">u8")[:, 0]
    right = np.ascontiguousarray(np.pad(edges[:, 8:], ((0, 0), (0, 16 - edge)))).view(">u8")[:, 0]
    doc, place = e["doc_id"].to_numpy()[ctx], e["start"].to_numpy()[ctx] + begin
    order = np.lexsort((place, doc, right, left, before, run))
    later = ~_new(run[order], before[order], left[order], right[order])
    doc, place = doc[order][later], place[order][later]
    order = np.lexsort((place, doc))
    doc, place = doc[order], place[order]
    head = _new(doc, place - np.arange(len(place)))  # strings at neighbouring places are one range
    at = np.flatnonzero(head)
    return pd.DataFrame({"doc_id": doc[at], "start": place[at].astype(np.int32), "size": (np.diff(np.append(at, len(place))) - 1 + length).astype(np.int32)})


def covered_ranges(docs: DataFrame, length: int = 100, hot_contexts: int = 50_000, chunk: int = 1 << 23) -> DataFrame:
    """(doc_id, start, size) in bytes of ranges that consist of earlier seen strings; they may overlap."""
    if not CORE + 8 <= length <= CORE + 16:
        raise ValueError("strings of 96 to 104 bytes are supported")
    spark = docs.sparkSession
    n = shared.shuffle_partitions(spark)
    parts = 4 * n
    chunk = max(chunk, min(1 << 26, parts << 14))
    texts = docs.select(shared.id_in(), F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") > 0)
    packed = texts.mapInPandas(lambda b: _entries(b, length, parts, chunk), "part int, blob binary")
    spread = packed.repartition(n, F.when(F.col("part") < 0, F.xxhash64("blob")).otherwise(F.col("part").cast("long")))
    known = shared.stored(spread.mapInPandas(lambda b: _resolve(b, length, hot_contexts), RANGES), "ranges")

    wanted = known.filter(F.col("gram").isNotNull()).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "anchor", "gram", "hot")).alias("cuts"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, cuts in zip(pdf["doc_id"], pdf["text"], pdf["cuts"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(doc, c["start"], c["anchor"], c["gram"], c["hot"], piece) for c in cuts if len(piece := raw[c["start"] : c["start"] + c["size"]]) == c["size"]]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "anchor", "gram", "hot", "raw"])

    pieces = texts.join(wanted, "doc_id").mapInPandas(cut, "doc_id long, start int, anchor int, gram long, hot boolean, raw binary")

    def compared(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", "start", "anchor", "gram", "raw").repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(lambda b: _compare(b, length), COVERED)

    covered = known.filter(F.col("gram").isNull()).select("doc_id", "start", "size")
    if known.filter("hot").isEmpty():
        return covered.union(compared(pieces))
    pieces = shared.stored(pieces, "pieces")
    covered = covered.union(compared(pieces.filter("not hot")))
    for whole in (False, True):  # by core, then string by string
        finer = shared.stored(pieces.filter("hot").mapInPandas(lambda b, whole=whole: _finer(b, length, whole), "doc_id long, start int, size int, anchor int, gram long, raw binary"), "finer")
        covered = covered.union(finer.filter("raw is null").select("doc_id", "start", "size"))
        left = finer.filter("raw is not null")
        often = shared.stored(left.groupBy("gram").agg(F.count("*").alias("times")).filter(F.col("times") > hot_contexts).select("gram", F.lit(True).alias("hot")), "often")
        if whole or often.isEmpty():
            return covered.union(compared(left))
        covered = covered.union(compared(left.join(often, "gram", "left_anti")))
        pieces = shared.stored(left.join(often, "gram"), "pieces")


COVERED = "doc_id long, start int, size int"


def _compare(batches: Iterator[pd.DataFrame], length: int, most: int = 8_000) -> Iterator[pd.DataFrame]:
    """The covered ranges of rows sorted by gram, in blocks that end where a gram ends."""
    held, size = [], 0
    for pdf in batches:
        held.append(pdf)
        size += len(pdf)
        if size < most:
            continue
        block = pd.concat(held, ignore_index=True)
        last = block["gram"].to_numpy() == block["gram"].iloc[-1]
        if not last.all():
            yield _strings(block[~last].reset_index(drop=True), length)
            block = block[last]
        held, size = [block], len(block)
    if held:
        yield _strings(pd.concat(held, ignore_index=True), length)


def _finer(batches: Iterator[pd.DataFrame], length: int, whole: bool, most: int = 8_000) -> Iterator[pd.DataFrame]:
    """Pieces around each core of the given pieces, or each string, named by a hash of it that deals them only.

    A batch's pieces are compared among each other: those covered come without bytes.
    """
    names = ["doc_id", "start", "size", "anchor", "gram", "raw"]

    def settled(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        gone = _strings(out, length)
        doc, start, end = (gone[c].to_numpy(np.int64) for c in ("doc_id", "start", "size"))
        end = start + end
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        first = {}
        for i, d in enumerate(doc.tolist()):
            first.setdefault(d, [i, i])[1] = i + 1
        keep = []
        for d, at, size in zip(out["doc_id"], out["start"], out["size"], strict=True):
            i, j = first.get(d, (0, 0))
            k = i + int(np.searchsorted(start[i:j], at, "right")) - 1
            keep.append(k < i or end[k] < at + size)
        return pd.concat([out[np.array(keep, bool)], gone.assign(anchor=None, gram=None, raw=None)[names]], ignore_index=True)

    rows: list[tuple] = []
    for pdf in batches:
        for doc, start, anchor, raw in zip(pdf["doc_id"], pdf["start"], pdf["anchor"], pdf["raw"], strict=True):
            for core in range(anchor % 8, len(raw) - CORE + 1, 8):
                if whole:
                    cuts = [(k, k + length) for k in range(max(0, core - 7), core + 1) if k + length <= len(raw)]
                else:
                    low, high = max(0, core - 7), min(len(raw), core + length)
                    cuts = [(low, high)] if high - low >= length else []
                for low, high in cuts:
                    named = xxhash.xxh3_64_intdigest(raw[low:high] if whole else raw[core : core + CORE])
                    rows.append((doc, start + low, high - low, core - low, named - (1 << 63), raw[low:high]))
            if len(rows) >= most:
                yield settled(rows)
                rows = []
    if rows:
        yield settled(rows)


def _kept(raw: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[bytes, int, int]:
    """Remaining bytes, removed bytes and removed runs."""
    if not len(starts):
        return raw, 0, 0
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, np.minimum(starts, len(raw)), 1)
    np.add.at(edge, np.minimum(starts + sizes, len(raw)), -1)
    gone = np.cumsum(edge)[:-1] > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def _with_ranges(docs: DataFrame, length: int, **options) -> DataFrame:
    """(doc_id, row, starts, sizes): each whole row with its covered ranges, null where it has none."""
    ranges = covered_ranges(docs, length, **options)
    by_doc = ranges.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("size").alias("sizes"))
    return docs.select(shared.id_in(), F.struct(*docs.columns).alias("row")).join(by_doc, "doc_id", "left")


def suffix_duplicates(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the digest of the remaining bytes.

    A byte goes if a ``length``-byte string over it also starts earlier: in a document of
    smaller doc_id, or earlier in the same one. Strings are those of the input. A null
    text is empty; a null doc_id counts as smallest; rows that repeat a doc_id never
    remove each other's bytes at the same place; a very long text goes on in pieces that
    overlap by a string; an empty table gives no row; further columns are ignored.
    """
    shared.share_code(docs.sparkSession)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, text, starts, sizes in zip(pdf["doc_id"], pdf["text"], pdf["starts"], pdf["sizes"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                kept, gone, runs = _kept(raw, *(np.array([] if x is None else x, np.int64) for x in (starts, sizes)))
                rows.append((doc, len(raw), gone, runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = _with_ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), length, **options)
    return shared.id_out(rows.select("doc_id", "row.text", "starts", "sizes").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, length: int = 100, **options) -> DataFrame:
    """The documents, all columns, with repeated strings cut from ``text``.

    Cut characters go whole: bytes that are left of one are dropped. A null text stays
    null; null ids, repeated rows, ties and very long texts are treated as in
    ``suffix_duplicates``; an empty table gives no row; columns of any name pass, and
    ``n_chars`` follows the text if there.
    """
    shared.share_code(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(texts: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for text, a, b in zip(texts, starts, sizes, strict=True):
            if text is not None and a is not None and len(a):
                text = _kept(text.encode("utf-8", "surrogatepass"), np.asarray(a, np.int64), np.asarray(b, np.int64))[0].decode("utf-8", "ignore")
            out.append(text)
        return pd.Series(out, index=texts.index, dtype=object)

    out = _with_ranges(docs, length, **options).select(F.col("row").withField("text", clean("row.text", "starts", "sizes")).alias("row")).select("row.*")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
