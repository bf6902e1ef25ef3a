"""Mixture-controlled packing of documents into token windows.

Each source is a queue of tokens. Deficit round-robin serves the queues: in every
window a queue earns a quantum, its share of the window, is served the whole tokens
of what it has earned, and carries the rest, its deficit, into the next window. The
slots that are then still free go to the largest deficits. So every window holds the
target proportions to within a token, and documents are cut where a window's turn of
their queue ends.

The rounds run in parallel: windows are grouped into epochs, and what every queue was
served before an epoch, thus the deficits carried into it, follows from the targets
alone (``Rounds.served_before``). A task works out only the epochs that its documents
lie in. Queue positions come from sums over (source, part), never from one global
sort; token ids are computed once and kept in the shared folder.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
TOKENS = "doc_id long, source string, part int, run long, n_tokens long, ids binary"


class Rounds:
    """The deficit round-robin schedule over queues of ``totals`` tokens.

    ``weights`` are the target proportions; the default is each queue's own share, so
    that all queues end together. When a queue runs dry, the others share its part.
    """

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = 4096, per_epoch: int = 256):
        self.totals = np.array(totals, np.int64)
        self.n, self.window, self.span = int(self.totals.sum()), window, window * per_epoch
        left, rates = self.totals.astype(float), np.array(totals if weights is None else weights, float)
        # break points of the targets: between two of them all rates are constant
        at, got = [0.0], [np.zeros(len(left))]
        if weights is None:
            at, got, left = [0.0, float(self.n)], [got[0], self.totals.astype(float)], np.zeros(len(left))
        while left.sum() > 0:
            live = left > 0
            share = np.where(live, np.maximum(rates, 1e-12), 0)
            share /= share.sum()
            step = (left[live] / share[live]).min()
            now = got[-1] + share * step
            dry = live & (self.totals - now < 1e-6 * max(1.0, step))
            now[dry] = self.totals[dry]
            at.append(at[-1] + step)
            got.append(now)
            left = self.totals - now
        at[-1] = float(self.n)
        self.at, self.got = np.array(at), np.array(got)
        self.epoch = lru_cache(64)(self._epoch)
        self.served_before = lru_cache(256)(self._served_before)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("epoch", "served_before")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.epoch = lru_cache(64)(self._epoch)
        self.served_before = lru_cache(256)(self._served_before)

    def target(self, t: float) -> np.ndarray:
        """What each queue should have been served after ``t`` tokens in all."""
        k = min(max(int(np.searchsorted(self.at, t, "right")) - 1, 0), len(self.at) - 2) if len(self.at) > 1 else 0
        if len(self.at) < 2:
            return self.got[0]
        width = self.at[k + 1] - self.at[k]
        return self.got[k] + (self.got[k + 1] - self.got[k]) * ((t - self.at[k]) / width if width else 1.0)

    def _served_before(self, g: int) -> np.ndarray:
        """Whole tokens served to each queue before global token ``g``; it never falls as g grows."""
        if g <= 0:
            return np.zeros(len(self.totals), np.int64)
        if g >= self.n:
            return self.totals

        def rounded(t: float) -> np.ndarray:
            return np.minimum(np.floor(self.target(t) + 0.5).astype(np.int64), self.totals)

        low, high = 0.0, float(self.n)
        for _ in range(200):
            mid = (low + high) / 2
            if mid in (low, high):
                break
            low, high = (low, mid) if rounded(mid).sum() >= g else (mid, high)
        served, exact = rounded(high), self.target(high)
        over = int(served.sum()) - g
        if over > 0:  # several queues step at the same moment: the last ones wait
            late = np.lexsort((np.arange(len(served)), exact + 0.5 - served))
            late = late[served[late] > 0][:over]
            served = served.copy()
            served[late] -= 1
        return served

    def _epoch(self, e: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens served before each window of epoch ``e`` (one row more than windows), and each queue's offset in them."""
        g, end = e * self.span, min((e + 1) * self.span, self.n)
        served = self.served_before(g)
        last = self.served_before(end)
        rows, offsets = [served], []
        now = self.target(g)
        deficit = now - served
        while g < end:
            size = min(self.window, end - g)
            after = self.target(g + size)
            deficit = deficit + (after - now)
            remaining = last - served
            take = np.clip(np.floor(deficit + 1e-9), 0, remaining).astype(np.int64)
            free = size - int(take.sum())
            while free > 0:
                able = np.flatnonzero(take < remaining)
                best = able[np.argsort(-(deficit - take)[able], kind="stable")][:free]
                take[best] += 1
                free -= len(best)
            while free < 0:
                able = np.flatnonzero(take > 0)
                worst = able[np.argsort((deficit - take)[able], kind="stable")][:-free]
                take[worst] -= 1
                free += len(worst)
            deficit = deficit - take
            offsets.append(np.cumsum(take) - take)
            served, now, g = served + take, after, g + size
            rows.append(served)
        return np.array(rows), np.array(offsets)

    def pieces(self, queue: int, start: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """(start, length, window, offset) of the cuts of ``length`` tokens that lie at ``start`` of ``queue``."""
        g = float(np.interp(start, self.got[:, queue], self.at))
        e, x, end = int(min(max(g, 0), self.n - 1)) // self.span, start, start + length
        while x < self.served_before(e * self.span)[queue]:
            e -= 1
        while x < end:
            while x >= self.served_before(min((e + 1) * self.span, self.n))[queue]:
                e += 1
            rows, offsets = self.epoch(e)
            served = rows[:, queue]
            w = int(np.searchsorted(served, x, "right")) - 1
            while x < end and w < len(offsets):
                stop = min(end, int(served[w + 1]))
                if stop > x:
                    yield x - start, stop - x, e * (self.span // self.window) + w, int(offsets[w, queue] + x - served[w])
                    x = stop
                w += 1


#: What the word tokenizer's own pattern tells apart in ASCII without apostrophes.
_RUNS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class WordEncoder:
    """Token ids by the tokenizers library, each distinct word encoded once.

    For tokenizers that drop white space and never join across it, ids of a text are
    the ids of its words in a row. ``splits_at_spaces`` asks the tokenizer for that before
    this class is used, and it holds some fixed texts against the library's ids of the whole
    texts, which it gives for all texts if they differ; besides, one text of ``every``, told by a hash of its beginning and its
    length, is held against the library's encoding of the whole text and takes that if they
    differ. So a text's ids depend on the text alone, in whichever worker or attempt.
    """

    every = 256
    probes = ("The quick brown fox jumps over the lazy dog.", "a b  c\nd, e; 12 345-6 (x_y) don't", "Zoë's naïve café — 日本語 ok 🙂 A1B2 ...", "one two\tthree\r\nfour <|x|> 'five' \"six\"")

    #: Words that are kept: so many, and up to so many bytes, as longer ones seldom recur.
    limit, longest = 600_000, 11

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if suffix:  # tokens that end a word, which tell the words of a joined text apart
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self.bare = self._bare() if suffix else None
        self.known: dict[bytes, bytes] = {}
        self.whole = self.by_word(list(self.probes)) != list(self._encode(list(self.probes)))

    def _bare(self):
        """The tokenizer without the steps that leave words of a-z as they are, or None if it isn't byte-level."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if "ByteLevel" not in str(self.tokenizer.pre_tokenizer):
            return None
        t = Tokenizer.from_str(self.tokenizer.to_str())
        t.normalizer = normalizers.Sequence([])
        t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = ["the quick brown fox", "zyxwv utsrq"]
        same = [e.ids for e in t.encode_batch_fast(probe, add_special_tokens=False)] == [e.ids for e in self.tokenizer.encode_batch_fast(probe, add_special_tokens=False)]
        return t if same else None

    def _encode(self, words: list[str]) -> Iterator[bytes]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # whatever other operators set in this worker
        for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False):
            yield np.array(e.ids, self.dtype).tobytes()

    def _joined(self, tokenizer, words: list[str], size: int = 256) -> list[bytes | None]:
        """Ids of words of letters, many to a text, cut after the tokens that end words; None where they don't fit."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out: list[bytes | None] = []
        groups = [words[i : i + size] for i in range(0, len(words), size)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids)
            stops = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else ids
            if len(stops) != len(group) or (len(stops) and stops[-1] != len(ids)):
                out += [None] * len(group)
                continue
            raw, stops = ids.astype(self.dtype).tobytes(), (stops * int(self.dtype[2])).tolist()
            out += [raw[i:j] for i, j in zip([0, *stops[:-1]], stops, strict=True)]
        return out

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        """Cuts that change no id: ASCII in lower case, letters, digits and marks apart; else a full stop or comma after the last letter.

        The letter must be one in lower case, too: that of a dotted capital I ends with a mark.
        """
        if "<" in word or "'" in word:  # may hold a special token or a contraction
            return (word,)
        if word.isascii():
            return tuple(_RUNS.findall(word.lower()))
        if len(word) > 1 and word[-1] in ".," and word[-2] < "ɐ" and word[-2].isalpha() and word[-2].lower().isalpha():
            return word[:-1], word[-1]
        return (word,)

    def _learn(self, words: list[bytes], plain: list[bool]) -> list[bytes]:
        """Ids of distinct words; ``plain`` ones have a-z only. Those of up to ``longest`` bytes are kept."""
        found = list(map(self.known.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        easy = [i for i in missing if plain[i]] if self.bare else []
        for i, x in zip(easy, self._joined(self.bare, [words[i].decode() for i in easy]) if easy else [], strict=True):
            found[i] = x
        hard = [i for i in missing if found[i] is None]
        split = [self._parts(words[i].decode("utf-8", "surrogatepass")) for i in hard]
        parts = list({p for ps in split for p in ps})
        letters = [p for p in parts if p.isalpha()] if self.ends is not None else []
        ids = {p: x for p, x in zip(letters, self._joined(self.tokenizer, letters) if letters else [], strict=True) if x is not None}
        alone = [p for p in parts if p not in ids]
        ids.update(zip(alone, self._encode(alone), strict=True))
        for i, ps in zip(hard, split, strict=True):
            found[i] = ids[ps[0]] if len(ps) == 1 else b"".join([ids[p] for p in ps])
        self.known.update((words[i], found[i]) for i in missing if len(words[i]) <= self.longest)
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole or not texts:
            return list(self._encode(texts))
        out = self.by_word(texts)
        tested = [i for i, t in enumerate(texts) if (zlib.crc32(t[:64].encode("utf-8", "surrogatepass")) + len(t)) % self.every == 0]
        for i, ids in zip(tested, self._encode([texts[i] for i in tested]) if tested else [], strict=True):
            out[i] = ids
        return out

    def by_word(self, texts: list[str]) -> list[bytes]:
        """Words are told apart in numpy, by up to 16 bytes as two integers; each distinct one is looked up once."""
        if len(self.known) > self.limit:
            self.known = {}
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b" ".join(raws) + b" "
        a = np.frombuffer(raw + bytes(16), np.uint8)
        stops = np.flatnonzero((a[: len(raw)] == 32) | (a[: len(raw)] == 10))
        starts = np.concatenate([[0], stops[:-1] + 1])
        starts, sizes = starts[stops > starts], (stops - starts)[stops > starts]
        short = np.flatnonzero(sizes <= 16)
        cells = a[starts[short][:, None] + np.arange(16)] * (np.arange(16) < sizes[short][:, None])
        low, high = np.ascontiguousarray(cells).view("<u8").T
        size = sizes[short].astype(np.uint64)
        key = shared.mix64(low + shared.mix64(high * np.uint64(3) + size))
        order = np.argsort(key)
        key, low, high, size = key[order], low[order], high[order], size[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = key[1:] != key[:-1]
        same = ~fresh[1:]
        if ((low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]))[same].any():  # two words with one key
            fresh[:] = True
        place = np.empty(len(starts), np.int64)
        place[short[order]] = np.cumsum(fresh) - 1
        at = short[order[fresh]]
        words = [raw[i:j] for i, j in zip(starts[at].tolist(), (starts[at] + sizes[at]).tolist(), strict=True)]
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(sizes > 16).tolist():
            w = raw[starts[i] : starts[i] + sizes[i]]
            place[i] = extra.setdefault(w, len(words) + len(extra))
        letters = ((cells >= 97) & (cells <= 122)).sum(1) == sizes[short]
        ids = self._learn([*words, *extra], [*letters[order[fresh]].tolist(), *[False] * len(extra)])
        width = int(self.dtype[2])
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // width
        begin = np.cumsum(count) - count
        per_word = count[place]
        until = np.cumsum(per_word)
        take = np.repeat(begin[place] - (until - per_word), per_word) + np.arange(int(until[-1]) if len(until) else 0)
        flat = np.frombuffer(b"".join(ids), self.dtype)[take].tobytes()
        ends = np.cumsum([len(r) + 1 for r in raws])
        edge = np.concatenate([[0], until])[np.searchsorted(starts, ends)] * width
        edge = [0, *edge.tolist()]
        return [flat[i:j] for i, j in zip(edge, edge[1:], strict=False)]


class TextEncoder(WordEncoder):
    """The same for any tokenizer: whole texts."""

    def __call__(self, texts: list[str]) -> list[bytes]:
        return list(self._encode(texts))


def probes() -> Iterator[str]:
    """Texts of all kinds of characters with spaces and marks on both sides."""
    for c in map(chr, [*range(1, 0x600), *range(0x600, 0x3100, 16), *range(0xFB00, 0xFF00, 64), *range(0x1F300, 0x1F700, 64)]):
        yield f"a{c} {c}b {c}. {c},\n{c} A{c}{c}. 1{c}\u0301 {c}'s"


@lru_cache
def splits_at_spaces(path: str) -> bool:
    """Whether the ids of texts are those of their words in a row, on every probe."""
    encode, texts = WordEncoder(path), list(probes())
    return encode.by_word(texts) == list(encode._encode(texts))


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, by_word: bool, kept_words: int | None = None) -> WordEncoder:
    key = (path, by_word)
    if key not in _encoders:
        _encoders[key] = (WordEncoder if by_word else TextEncoder)(path)
    _encoders[key].limit = kept_words or WordEncoder.limit
    return _encoders[key]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, by_word: bool, kept_words: int | None = None) -> DataFrame:
    """Ids of every document with ``end_id`` last, with its place among its source's documents of the same part."""

    def ids_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, by_word, kept_words)
        last = np.array([end_id], encode.dtype).tobytes()
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                some = pdf.iloc[at : at + 1024]
                ids = [x + last for x in encode(some["text"].tolist())]
                sizes = [len(x) // len(last) for x in ids]
                runs = []
                for source, n in zip(some["source"], sizes, strict=True):
                    runs.append(seen[source])
                    seen[source] += n
                yield pd.DataFrame({"doc_id": some["doc_id"], "source": some["source"], "part": part, "run": runs, "n_tokens": sizes, "ids": ids})

    source = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    rows = docs.select(shared.id_in(), source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(ids_of, TOKENS)


def _running(units: DataFrame, keys: list[str], block, order: list[str], out: str) -> DataFrame:
    """``units`` with the tokens of the units before each one of the same ``keys``, in two levels.

    ``block`` splits a key's units into stretches in order; sums of stretches run over the
    stretches, units run inside theirs, so no task gets all units of a key.
    """
    units = units.withColumn("_block", block)
    by = [*keys, "_block"]
    sums = units.groupBy(*by).agg(F.sum("tokens").alias("_all"))
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select(*by, F.coalesce(F.sum("_all").over(over), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = units.withColumn("_inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(ahead, by)
    return rows.withColumn(out, F.col("_inside") + F.col("_ahead")).drop("_block", "_inside", "_ahead")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, weights: dict[str, float] | None = None, max_queues: int = 1024, by_word: bool | None = None, kept_words: int | None = None) -> DataFrame:
    """Pieces of all documents, dealt into sequences of ``window`` tokens.

    ``docs`` has doc_id, text and source; further columns are ignored. A null text is
    empty, so it has ``end_id`` only; a null source is a source of its own; repeated rows
    are packed as often as they occur; an empty table gives no row. Only the last
    sequence can be short. ``weights`` maps sources to target proportions (default: their
    shares of all tokens); a source without one comes after those that have one.

    A source has a queue of its own if it has a weight or at least 1 / ``max_queues`` of
    all tokens. The others' queue is a schedule of a second level: each source's documents,
    in stretches of at most a window or one document, come at the moment that is their
    share of their source, so they keep proportions too, to within a stretch each. A very
    long text is cut wherever a window ends; documents of one source and part come in the
    order of their rows, which settles ties.

    ``by_word`` encodes distinct words once; by default where ``splits_at_spaces``.
    ``kept_words`` bounds the words whose ids a worker remembers, for speed only.
    """
    spark = docs.sparkSession
    shared.share_code(spark)
    by_word = splits_at_spaces(tokenizer) if by_word is None else by_word
    tokens = shared.stored(tokenised(docs, tokenizer, end_id, by_word, kept_words), "tokens")
    by_source = tokens.groupBy("source").agg(F.sum("n_tokens").alias("total"))
    n = by_source.agg(F.sum("total")).first()[0] or 0
    if not n:
        return spark.createDataFrame([], PIECES)
    own = by_source.filter((F.col("total") * max_queues >= n) | F.col("source").isin(list(weights or {}))).orderBy("source").collect()  # at most max_queues and the weights given
    names, totals = [r["source"] for r in own], [r["total"] for r in own]
    pooled = n - sum(totals)
    if pooled:
        names, totals = [*names, None], [*totals, pooled]
    rates = None if weights is None else [float(weights.get(x, 0.0)) if x is not None else 0.0 for x in names]
    rounds = Rounds(totals, rates, window)

    queue = spark.createDataFrame([(x, i) for i, x in enumerate(names) if x is not None], "source string, queue int")
    if pooled:
        tokens = tokens.join(F.broadcast(queue), "source", "left").withColumn("cell", F.when(F.col("queue").isNull(), F.floor(F.col("run") / window)).otherwise(0)).drop("queue")
    else:
        tokens = tokens.withColumn("cell", F.lit(0).cast("long"))
    unit = ["source", "part", "cell"]
    units = tokens.groupBy(*unit).agg(F.sum("n_tokens").alias("tokens"), F.min("run").alias("first"))
    base = shared.stored(_running(units, ["source"], F.floor(F.col("part") / 256), ["part", "cell"], "base").join(F.broadcast(queue), "source", "left"), "queue-base")
    if pooled:
        spread = 4 * shared.shuffle_partitions(spark)
        when = (F.col("base") + F.col("tokens") * (F.pmod(F.xxhash64("source"), F.lit(1 << 20)) / (1 << 20))) / F.col("total")
        timed = base.filter(F.col("queue").isNull()).join(by_source, "source").withColumn("_when", when).drop("base", "queue")
        placed = _running(timed, [], F.floor(F.col("_when") * spread), ["_when", *unit], "base").withColumn("queue", F.lit(len(names) - 1))
        columns = [*unit, "first", "queue", "base"]
        base = shared.stored(base.filter(F.col("queue").isNotNull()).select(*columns).union(placed.select(*columns)), "queue-base")
    base = base.select(*unit, "queue", (F.col("base") - F.col("first")).alias("base"))  # a unit's documents count from the part's start

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, source, q, start, n, ids in zip(pdf["doc_id"], pdf["source"], pdf["queue"], pdf["base"] + pdf["run"], pdf["n_tokens"], pdf["ids"], strict=True):
                wide = np.frombuffer(ids, f"<u{len(ids) // n}").astype("<u4")
                for a, size, w, off in rounds.pieces(q, start, n):
                    rows.append((doc, a, size, zlib.crc32(wide[a : a + size]), n, w, off, source))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])

    pieces = tokens.join(base, unit).select("doc_id", "source", "queue", "base", "run", "n_tokens", "ids").mapInPandas(deal, PIECES)
    return shared.id_out(pieces)
