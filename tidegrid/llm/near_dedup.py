"""Near duplicates by SetSketch registers.

A document's set are the hashes of its distinct word shingles. Register i of its sketch
is the truncated, exponentially spaced minimum ``floor(1 - log_b(min_x e_i(x)))`` of
exponential variates of its shingles; the sketch of a union is the maximum by register.
Registers are grouped into bands; documents that agree on a band are candidates. The
joint likelihood of two sketches, with the known set sizes, estimates the resemblance;
candidates that can't reach the threshold go, all others are verified on their full sets.

Documents with one and the same set are one class from the start. Candidates are first
taken between each bucket's members and its least one, then, where a bucket still holds
several components, and its most central one. What is still apart after that and can have
a link by two exact bounds (the sets' sizes, and the shingles of each set that no other
candidate has) is compared in blocks: a task intersects the sets of two blocks at once
and emits only links between components. So no pair is emitted inside what is already
connected, and every link between components that the bands can see is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .graph import components, merged

REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.001, 20.0, 65534
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 32, (REGISTERS, 1), np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, (REGISTERS, 1), np.uint32) | np.uint32(1)
SKETCH = "doc_id long, n_shingles long, print binary, bands array<long>"


def registers(shingles: np.ndarray, block: int = 4096) -> np.ndarray:
    """SetSketch registers of a non-empty set of 64-bit hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(low), block):
        x, y = low[None, at : at + block], high[None, at : at + block]
        for r in range(0, REGISTERS, 32):
            h = x * _A[r : r + 32] + y * _B[r : r + 32]
            h ^= h >> np.uint32(16)
            np.minimum(least[r : r + 32], (h * np.uint32(0x7FEB352D)).min(1), out=least[r : r + 32])
    return truncated(-np.log1p(-(least + 0.5) / 2.0**32) / RATE)


def truncated(minima: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(1 - np.log(minima) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _log(x: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(x, 1e-12))


def _differs(x: np.ndarray) -> np.ndarray:
    """Probability that the register of the set with share x of its own exceeds the other's."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


_GRID = np.linspace(0, 1, 201)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely resemblance of each pair of sketches (rows) with known set sizes."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    up, down = _differs(u - v * _GRID), _differs(v - u * _GRID)
    chance = more * _log(up) + less * _log(down) + (a.shape[1] - more - less) * _log(1 - up - down)
    chance = np.where(_GRID <= np.minimum(u / v, v / u) + 0.005, chance, -np.inf)
    return _GRID[chance.argmax(1)]


def shingles(text: str, words: int) -> np.ndarray:
    return shared.shingle_hashes(shared.word_hashes(text), words)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """Set size, digest of the set and banded registers of every document; no digest without words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes, prints, bands = [], [], []
            for text in pdf["text"]:
                s = shingles(text, words)
                sizes.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                bands.append(registers(s).view("<i8") if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": sizes, "print": prints, "bands": bands})

    return docs.select(shared.id_in(), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SKETCH)


def likely(pairs: DataFrame, reps: DataFrame, threshold: float, margin: float) -> DataFrame:
    """The pairs (a, b) whose sizes allow ``threshold`` and whose estimate is at most ``margin`` below it."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            for at in range(0, len(pdf), 1000):
                some = pdf.iloc[at : at + 1000]
                x, y = (np.stack(some[c].to_numpy()).astype("<i8").view("<u2") for c in ("bands_a", "bands_b"))
                j = estimate(x, y, some["n_a"].to_numpy(float), some["n_b"].to_numpy(float))
                yield some.loc[j >= threshold - margin, ["a", "b"]]

    a = reps.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bands").alias("bands_a"))
    b = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bands").alias("bands_b"))
    sized = pairs.join(a, "a").join(b, "b").filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-6)
    return sized.mapInPandas(keep, "a long, b long").distinct()


def set_table(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, set) of the documents in ``ids``: the sorted hashes of each full set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "set": [shingles(t, words).tobytes() for t in pdf["text"]]})

    texts = docs.select(shared.id_in(), F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(ids.hint("merge"), "doc_id", "left_semi").mapInPandas(run, "doc_id long, set binary").filter(F.length("set") > 0)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, members: int = 500) -> DataFrame:
    """The pairs (a, b) that are links by their full sets.

    Each set of a pair is sent to the place of a; places with over ``members`` sets are
    split, and the set of a goes to each part.
    """
    places = pairs.groupBy("a").agg(F.ceil(F.count("*") / members).cast("int").alias("parts"))
    guests = pairs.join(places, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("place"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("guest"))
    hosts = places.select(F.col("a").alias("doc_id"), F.col("a").alias("place"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("guest"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, host = None, np.zeros(0, np.uint64)
        for pdf in batches:
            found = []
            for place, part, guest, doc, s in zip(pdf["place"], pdf["part"], pdf["guest"], pdf["doc_id"], pdf["set"], strict=True):
                mine = np.frombuffer(s, np.uint64)
                if not guest:
                    where, host = (place, part), mine
                elif where == (place, part):
                    both = len(np.intersect1d(host, mine, assume_unique=True))
                    if 100 * both >= percent * (len(host) + len(mine) - both):
                        found.append((place, doc))
            yield pd.DataFrame(found, columns=["a", "b"])

    sent = sets.join(guests.union(hosts).hint("merge"), "doc_id")
    n = shared.shuffle_partitions(sets.sparkSession)
    return sent.repartition(n, "place", "part").sortWithinPartitions("place", "part", "guest", "doc_id").mapInPandas(compare, "a long, b long").distinct()


def shared_counts(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, n_set, common): each candidate's set size and how many of its shingles another candidate has too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                values = [np.frombuffer(s, np.int64) for s in some["set"]]
                yield pd.DataFrame({"shingle": np.concatenate(values), "doc_id": np.repeat(some["doc_id"].to_numpy(), [len(v) for v in values])})

    chosen = sets.join(ids, "doc_id", "left_semi")
    single = chosen.mapInPandas(run, "shingle long, doc_id long").groupBy("shingle").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1")
    alone = single.groupBy("doc_id").agg(F.count("*").alias("alone"))
    sizes = chosen.select("doc_id", (F.length("set") / 8).cast("long").alias("n_set"))
    return sizes.join(alone, "doc_id", "left").select("doc_id", "n_set", (F.col("n_set") - F.coalesce("alone", F.lit(0))).alias("common"))


def _within(overlap, total, percent: int):
    """Whether an overlap of at most ``overlap`` in two sets of ``total`` together can be a link."""
    return 100 * overlap >= percent * (total - overlap)


def still_mixed(members: DataFrame, percent: int) -> DataFrame:
    """Members (bucket, doc_id, component, n_set, common) that can have a link to another component of their bucket.

    The bound takes the smallest size and the largest common part of a whole bucket, so
    members are compared with the bucket, not with each other.
    """
    able = shared.with_groups(members, "bucket", F.min("n_set").alias("least"), F.max("common").alias("most"))
    overlap = F.least("common", "most")
    able = able.filter(_within(overlap, F.col("n_set") + F.col("least"), percent)).drop("least", "most")
    return apart(shared.stored(able, "able"))


def apart(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several components."""
    return shared.with_groups(members, "bucket", F.min("component").alias("x"), F.max("component").alias("y"), where="x <> y").drop("x", "y")


def _links(x: list[np.ndarray], y: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """Which pairs of the sets in x and y are links: shared shingles counted by products of 0/1 blocks."""
    names, times = np.unique(np.concatenate([*x, *y]), return_counts=True)
    names = names[times > 1]
    both = np.zeros((len(x), len(y)), np.float64)

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets])
        at = np.minimum(np.searchsorted(names, flat), max(0, len(names) - 1))
        hit = names[at] == flat if len(names) else np.zeros(len(flat), bool)
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order]

    (at_x, own_x), (at_y, own_y) = places(x), places(y)
    for low in range(0, len(names), columns):
        parts = []
        for at, own, n in ((at_x, own_x, len(x)), (at_y, own_y, len(y))):
            i, j = np.searchsorted(at, (low, low + columns))
            dense = np.zeros((n, columns), np.float32)
            dense[own[i:j], at[i:j] - low] = 1
            parts.append(dense)
        both += parts[0] @ parts[1].T
    size_x, size_y = (np.array([len(v) for v in sets], float) for sets in (x, y))
    return 100 * both >= percent * (size_x[:, None] + size_y[None] - both)


def links_across(members: DataFrame, sets: DataFrame, percent: int, block: int = 400, shingles_a_block: int = 1 << 20) -> DataFrame:
    """Links (a, b) between components: ``members`` has doc_id, component, family and n_set, and only families are compared.

    A family is split into blocks of some ``block`` documents with ``shingles_a_block``
    shingles, or one with more; each pair of its blocks is one place. A document gives at
    most one link to each component that a block holds, which connects as well as all.
    """
    parts = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("n_set") / shingles_a_block)).cast("int").alias("parts"))
    placed = members.join(parts, "family").withColumn("mine", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.select("doc_id", "component", "family", "mine", F.least("mine", "k").alias("i"), F.greatest("mine", "k").alias("j"))

    def settle(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        x = [r for r in rows if r[0] == key[1]]
        y = x if key[1] == key[2] else [r for r in rows if r[0] == key[2]]
        if not x or not y:
            return []
        linked = _links([r[3] for r in x], [r[3] for r in y], percent)
        linked &= np.array([r[2] for r in x])[:, None] != np.array([r[2] for r in y])[None]
        out = {}
        for i, j in zip(*np.nonzero(linked), strict=True):
            out.setdefault((x[i][1], y[j][2]), y[j][1])
        return [(min(a, b), max(a, b)) for (a, _), b in out.items()]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rows = None, []
        for pdf in batches:
            found = []
            for here, mine, doc, component, s in zip(zip(pdf["family"], pdf["i"], pdf["j"], strict=True), pdf["mine"], pdf["doc_id"], pdf["component"], pdf["set"], strict=True):
                if here != key:
                    found += settle(key, rows) if rows else []
                    key, rows = here, []
                rows.append((mine, doc, component, np.frombuffer(s, np.uint64)))
            yield pd.DataFrame(found, columns=["a", "b"])
        yield pd.DataFrame(settle(key, rows) if rows else [], columns=["a", "b"])

    n = shared.shuffle_partitions(sets.sparkSession)
    sent = sets.join(placed.hint("merge"), "doc_id")
    return sent.repartition(n, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, margin: float = 0.2) -> DataFrame:
    """Per document: n_shingles, component_id and kept.

    Links are pairs with ``100 * intersection >= percent * union`` of ``words``-word
    shingle sets (a shorter text is one shingle). A document without words or text links
    with nothing; a very long one is sketched and verified whole. Rows that share a doc_id count as one node. An empty table gives no
    row; further columns are ignored. Two documents at the threshold miss every band with
    a probability under 1e-7; the likelihood's margin is over five standard deviations.
    """
    spark = docs.sparkSession
    shared.share_code(spark)
    threshold = percent / 100
    table = shared.stored(sketches(docs, words), "sketches")
    classes = table.filter(F.col("print").isNotNull()).groupBy("print").agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("r"))
    classes = shared.stored(classes.select("print", "r.*"), "classes")
    buckets = classes.select("doc_id", F.posexplode("bands").alias("band", "key")).select("doc_id", F.xxhash64("band", "key").alias("bucket"))
    meeting = shared.stored(shared.with_groups(shared.stored(buckets, "all-buckets"), "bucket", F.min("doc_id").alias("a"), where="n > 1"), "buckets")  # members of buckets with more than one
    sets = shared.stored(set_table(docs, meeting.select("doc_id").distinct(), words), "sets")

    tried = shared.stored(likely(meeting.filter("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct(), classes, threshold, margin), "pairs")
    found = shared.stored(components(shared.stored(verified(tried, sets, percent), "verified")), "components")

    def named(members: DataFrame) -> DataFrame:
        """Members with their components as far as they are known; those in buckets with several."""
        members = members.drop("component").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        return apart(shared.stored(members.withColumn("component", F.coalesce("component", "doc_id")), "named"))

    rest = shared.stored(named(meeting.select("bucket", "doc_id")), "apart")
    if not rest.isEmpty():
        counts = shared.stored(shared_counts(sets, rest.select("doc_id").distinct()), "counts")
        rest = shared.stored(still_mixed(shared.stored(rest.join(counts, "doc_id"), "counted"), percent), "mixed")
    if not rest.isEmpty():  # the most central member of each bucket leads
        columns = ("doc_id", "component", "n_set", "common")
        led = F.max_by(F.struct(*columns), F.struct((F.col("common") / F.col("n_set")).alias("share"), "doc_id")).alias("l")
        side = shared.with_groups(rest, "bucket", led).filter("component <> l.component").filter(_within(F.least("common", "l.common"), F.col("n_set") + F.col("l.n_set"), percent))
        pairs = side.select(F.least("doc_id", "l.doc_id").alias("a"), F.greatest("doc_id", "l.doc_id").alias("b")).distinct()
        new = shared.stored(likely(pairs.join(tried, ["a", "b"], "left_anti"), classes, threshold, margin), "pairs")
        found = merged(found, shared.stored(verified(new, sets, percent), "verified"))
        rest = shared.stored(still_mixed(shared.stored(named(rest), "apart"), percent), "mixed")
    if not rest.isEmpty():  # families: documents that buckets with several components tie together
        ties = shared.with_groups(rest, "bucket", F.min("doc_id").alias("a")).select("a", F.col("doc_id").alias("b")).distinct()
        family = components(ties).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
        more = shared.stored(links_across(rest.select("doc_id", "component", "n_set").distinct().join(family, "doc_id"), sets, percent), "across")
        if not more.isEmpty():
            found = merged(found, more)

    member = classes.select("print", F.col("doc_id").alias("rep")).join(found.withColumnRenamed("node", "rep"), "rep", "left")
    member = member.select("print", F.coalesce("component", "rep").alias("component"))
    out = table.select("doc_id", "n_shingles", "print").join(member, "print", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return shared.id_out(shared.id_out(out.withColumn("kept", F.col("doc_id") == F.col("component_id"))), "component_id")


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, all columns: the one with the least doc_id.

    Rows that share a doc_id are versions of one document: of them the least text stays,
    and of equal texts one row. A row without a doc_id is a document of its own, named by a
    hash of its text above all other ids (below 1 << 62), so its exact copies are one
    document and a copy with an id is preferred to it. A document without words or text
    links with nothing; a very long one is compared whole. An empty table gives no row;
    columns of any name pass.
    """
    unnamed = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 2)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), unnamed).alias("key"), F.struct(*docs.columns).alias("row"))
    found = near_duplicates(rows.select(F.col("key").alias("doc_id"), "row.text"), words, percent)
    found = shared.stored(found.groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("times")).filter("kept"), "kept")
    kept = rows.join(found.select(F.col("doc_id").alias("key"), "times"), "key")
    several = kept.filter("times > 1").groupBy("key").agg(F.min_by("row", F.struct("row.text", F.to_json("row"))).alias("row"))
    return kept.filter("times = 1").select("row.*").union(several.select("row.*"))
