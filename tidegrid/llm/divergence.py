"""Audit of how the sources of a language differ in their terms.

1. Terms. A task's texts are one byte buffer; a lookup table tells term bytes and lowers
   A-Z, so edges of runs are the boundaries. Slices are grouped by xxhash, each compared
   byte by byte with its group's first one, and counted by (language, source).
2. Kept terms of a language, the groups' totals, and each group's shares are sums and
   joins. Shares and divergences are integers, by long division where a product could
   exceed 64 bits.
3. Pairs of sources. A language's terms are dealt in parts, its sources in blocks; a task
   has a part's counts for two blocks as a sparse matrix, a row a source. Where neither
   source has a term both shares are constant, so only what differs from that is summed,
   over the rows' entries with ``reduceat``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

U64 = np.uint64
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[0x41:0x5B] = TERM_BYTE[0x61:0x7B] = TERM_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
COUNTS = "lang string, source string, term string, n long, docs long"


def slices(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one lowered buffer, begin and end of each term in it, and the number of its text."""
    raw = np.frombuffer(b"\0".join(texts), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = TERM_BYTE[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = np.append(0, np.cumsum(sizes + 1))
    return LOWER[raw], edges[::2], edges[1::2], np.searchsorted(bounds, edges[::2], "right") - 1


def grouped(low: np.ndarray, begin: np.ndarray, end: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): equal hashes whose bytes are equal, too."""
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist(), strict=True)), U64, len(begin))
    _, first, group = np.unique(hashes, return_index=True, return_inverse=True)
    while True:
        size, model = end - begin, first[group]
        same = size == size[model]
        at = np.flatnonzero(same)
        offset = np.cumsum(size[at]) - size[at]
        step = np.arange(int(size[at].sum()))
        here, there = (np.repeat(b[at] - offset, size[at]) + step for b in (begin, begin[model]))
        equal = low[here] == low[there]
        if len(at):
            same[at] = np.logical_and.reduceat(equal, offset)
        if same.all():
            return group, first
        other = np.flatnonzero(~same)  # another term with this hash: the first of them opens a group of its own
        _, lead, new = np.unique(group[other], return_index=True, return_inverse=True)
        group[other] = len(first) + new
        first = np.append(first, other[lead])


class Counter:
    """Occurrences and documents by (group, term) of one task, of bounded size."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.terms: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, pdf: pd.DataFrame) -> None:
        groups, terms = self.groups, self.terms
        low, begin, end, doc = slices([t.encode("utf-8", "surrogatepass") for t in pdf["text"]])
        if not len(begin):
            return
        name, first = grouped(low, begin, end)
        raw = low.tobytes()
        codes = np.array([terms.setdefault(raw[a:b], len(terms)) for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)], np.int64)
        of = np.array([groups.setdefault(g, len(groups)) for g in zip(pdf["lang"], pdf["source"], strict=True)], np.int64)
        in_doc, n = np.unique(doc * len(first) + name, return_counts=True)
        key = of[in_doc // len(first)] << 40 | codes[in_doc % len(first)]
        self._merge(key, n.astype(np.int64), np.ones(len(key), np.int64))

    def _merge(self, key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> None:
        self.parts.append((key, n, docs))
        self.size += len(key)
        if self.size > self.most:
            self._fold()

    def _fold(self) -> None:
        key, n, docs = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        key = key[order]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.parts = [(key[head], np.add.reduceat(n[order], head), np.add.reduceat(docs[order], head))]
        self.size = len(head)

    @property
    def full(self) -> bool:
        return self.size > self.most // 2 or len(self.terms) > self.most // 2

    def rows(self, step: int = 100_000) -> Iterator[pd.DataFrame]:
        if self.parts:
            self._fold()
            (key, n, docs), terms, groups = self.parts[0], list(self.terms), list(self.groups)
            for i in range(0, len(key), step):
                some = key[i : i + step]
                of = [groups[g] for g in (some >> 40).tolist()]
                names = [terms[t].decode("utf-8", "surrogatepass") for t in (some & (1 << 40) - 1).tolist()]
                yield pd.DataFrame({"lang": [g[0] for g in of], "source": [g[1] for g in of], "term": names, "n": n[i : i + step], "docs": docs[i : i + step]})
        self.__init__(self.most)


def term_counts(docs: DataFrame, most: int = 1 << 20) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term; a task's part of them, not yet added up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Counter(most)
        for pdf in batches:
            if len(pdf):
                held.add(pdf)
            if held.full:
                yield from held.rows()
        yield from held.rows()

    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))).mapInPandas(count, COUNTS)


#: Of 1,000,000,000 parts, in three steps of 1,000, so that a product stays within 64 bits for totals under 9e15.
STEPS, STEP = 3, 1000


def share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10 ** 9 * (n + 2) / total)."""
    rest, out = n + 2, 0
    out, rest = rest // total, rest % total
    for _ in range(STEPS):
        out, rest = out * STEP + rest * STEP // total, rest * STEP % total
    return 1 + out


def share_column(n: Column, total: Column) -> Column:
    """``share`` as an expression."""
    whole = lambda a, b: F.call_function("div", a, b)
    rest = n + F.lit(2).cast("long")
    out, rest = whole(rest, total), rest % total
    for _ in range(STEPS):
        out, rest = out * STEP + whole(rest * STEP, total), rest * STEP % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PAIRS = "lang string, source string, item string, value long"


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """What one part of a language's terms adds to the divergences of the sources of two blocks."""
    heads = rows[rows["term"].isna()].drop_duplicates("source").sort_values("source")
    sources, total, own = heads["source"].to_numpy(), heads["total"].to_numpy(np.int64), heads["own"].to_numpy()
    lang, lo, hi, part, kept = rows["lang"].iloc[0], rows["lo"].iloc[0], rows["hi"].iloc[0], rows["part"].iloc[0], int(rows["kept"].iloc[0])
    n = len(sources)
    sums = np.zeros((n, n), np.int64)
    if kept:
        bare = share(np.zeros(n, np.int64), total)
        none = divergence(bare[:, None], bare[None])
        if part == 0:
            sums += kept * none
        entries = rows[rows["term"].notna()]
        row, column = np.searchsorted(sources, entries["source"].to_numpy()), pd.factorize(entries["term"])[0]
        order = np.lexsort((column, row))
        row, column = row[order], column[order]
        if len(row):
            data = share(entries["n"].to_numpy(np.int64)[order], total[row])
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))  # of each row that isn't empty
            filled, ends = row[first], np.append(first, len(row))
            place = {int(r): i for i, r in enumerate(filled)}
            for t in range(n):
                dense, has = np.full(column.max() + 1, bare[t]), np.zeros(column.max() + 1, bool)
                if t in place:
                    cut = slice(ends[place[t]], ends[place[t] + 1])
                    dense[column[cut]], has[column[cut]] = data[cut], True
                more = divergence(data, dense[column]) - none[row, t]
                sums[filled, t] += np.add.reduceat(more, first)
                sums[t, filled] += np.add.reduceat(np.where(has[column], 0, more), first)
    a, b = np.nonzero(~np.eye(n, dtype=bool) & ((own[:, None] == lo) & (own[None] == hi) | (own[:, None] == hi) & (own[None] == lo)))
    return pd.DataFrame({"lang": lang, "source": sources[a], "item": sources[b], "value": sums[a, b]})


def source_divergence(docs: DataFrame, least_docs: int = 10, most_terms: int = 10, part_terms: int = 2048, block_sources: int = 256) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source is from each other one of its language (``pair``), and its most overrepresented terms (``term``).

    Terms are runs of ASCII letters, lowered, and of all other characters beyond ASCII. A
    language keeps those in at least ``least_docs`` of its rows. Null text, lang and source
    are empty strings; each row is a document, also where a doc_id repeats; a language
    without kept terms has pairs of value 0; a very long text is part of a task's buffer as
    a whole; ties go by the item's bytes; an empty table gives no row; further columns are
    ignored.
    """
    spark = docs.sparkSession
    shared.share_code(spark)
    n = shared.shuffle_partitions(spark)
    by_term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).repartition(n, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    common = counts.withColumns({"docs": F.sum("docs").over(by_term), "all": F.sum("n").over(by_term), "head": (F.min("source").over(by_term) == F.col("source")).cast("long")})
    kept = shared.stored(common.filter(F.col("docs") >= least_docs).drop("docs"), "terms")
    groups = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    zero = F.lit(0).cast("long")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("head").alias("kept"))
    sized = groups.join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    known = sized.select("lang", "source", "sources", F.coalesce("kept", zero).alias("kept"), *((F.coalesce(c, zero) + 2 * F.coalesce("kept", zero)).alias(c) for c in ("total", "lang_total")))
    known = shared.stored(known, "sources")

    blocks, parts = F.call_function("div", "sources", F.lit(block_sources)) + 1, F.call_function("div", "kept", F.lit(part_terms)) + 1
    entries = kept.select("lang", "source", "term", "n", "all").join(known, ["lang", "source"])
    upto = lambda c: F.explode(F.sequence(zero, c - 1))
    columns = ["lang", "source", "term", "n", "total", "kept", "sources", "part"]
    both = entries.withColumn("part", F.pmod(F.xxhash64("term"), parts)).select(*columns).union(known.withColumns({"term": F.lit(None).cast("string"), "n": zero, "part": upto(parts)}).select(*columns))
    both = both.withColumn("own", F.pmod(F.xxhash64("source"), blocks)).withColumn("other", upto(blocks))
    dealt = both.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "sources")
    sums = dealt.groupBy("lang", "part", "lo", "hi").applyInPandas(_block, PAIRS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share_column(F.col("n"), F.col("total")), share_column(F.col("all"), F.col("lang_total"))
    over = entries.withColumns({"p": p, "q": q}).filter("p > q").withColumn("value", F.expr("(p - q) * (p - q) div (p + q)"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = sums.withColumn("rank", place).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    terms = over.withColumn("item", F.col("term")).withColumn("rank", place).filter(F.col("rank") <= most_terms).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.union(terms)
