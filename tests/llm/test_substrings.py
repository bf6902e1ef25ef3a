"""Substring dedup by recompression, held against a plain dictionary of windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import recompression, shared, substring_dedup

SCHEMA = "doc_id long, text string"


def by_dictionary(docs, window):
    """doc_id -> kept words, for distinct doc_ids without null."""
    seen, kept = {}, {}
    for doc, text in sorted(docs):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = b" ".join(words[i : i + window])
            if seen.setdefault(key, (doc, i)) != (doc, i):
                gone[i : i + window] = [True] * window
        kept[doc] = [w for w, g in zip(words, gone, strict=True) if not g]
    return kept


def corpus(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([2, 3, 40, 500]))]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 70))] for _ in range(6)]
    docs = []
    for i in range(40):
        words = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.4:
                words += rng.choice(passages)
            elif kind < 0.5:
                words += [rng.choice(vocabulary)] * rng.randint(1, 60)
            elif kind < 0.6:
                words += rng.sample(vocabulary, 2) * rng.randint(1, 40)
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(0, 50))]
        docs.append((i * 3, rng.choice([" ", "\n", " \t "]).join(words)))
    return docs + [(200 + i, docs[i % 3][1]) for i in range(10)]


@pytest.mark.parametrize("seed", range(6))
def test_equals_dictionary(spark, seed):
    docs = corpus(seed)
    expected = by_dictionary(docs, 20)
    for options in ({}, {"hot": 0}, {"chunk": 50}):
        rows = substring_dedup.substring_duplicates(spark.createDataFrame(docs, SCHEMA).repartition(4), 20, **options).collect()
        assert len(rows) == len(docs)
        for r in rows:
            kept = expected[r.doc_id]
            assert (r.n_words - r.n_removed, r.kept_sha256) == (len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), (options, r.doc_id)


def test_long_text_goes_in_pieces(monkeypatch):
    """Cut into small pieces or not, a text gives the same contexts but for the breaks."""
    import pandas as pd

    words = [f"w{random.Random(1).random()}"] + [f"w{i % 97}" for i in range(5000)]
    frame = pd.DataFrame({"doc_id": [1], "version": [0], "text": [" ".join(words)]})

    def windows(step):
        found = set()
        for part in substring_dedup._contexts(iter([frame]), 20, 4, 1 << 20, 16, step):
            for p, blob in zip(part["part"], part["blob"], strict=True):
                e = substring_dedup.unpack(blob, substring_dedup.CONTEXT)
                e = e[e["kind"] != substring_dedup.MARK]
                found |= {int(s) + k for s, more in zip(e["start"], e["more"], strict=True) for k in range(int(more) + 1)}
        return found

    assert windows(1 << 19) == windows(64) == set(range(len(words) - 19))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=20, max_size=60), st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_equal_windows_have_equal_cores(inner, before, after):
    """Whatever stands around it, a window's core has the same name at the same offset."""
    names = np.array([shared._hashes[b"%d" % w] for w in [*before, *inner, *after, *inner]], np.uint64)
    at, core, place = recompression.cores(names, np.array([0, len(names)]), 20)
    second = len(before) + len(inner) + len(after)
    for k in range(len(inner) - 19):
        i, j = len(before) + k, second + k
        assert core[i] == core[j] and place[i] - i == place[j] - j
    assert (place >= at).all() and (place < at + 20).all()


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (5, text + " x", 4), (7, None, 5), (8, "", 6), (9, "one two", 7), (2, "é a " + text, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, version long")
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in substring_dedup.substring_duplicates(docs).collect())
    # the null id is the first; both equal rows of document 5 lose what it has, the third one too but for its last word
    assert found == [(-1, 30, 0), (2, 31, 30), (5, 30, 30), (5, 30, 30), (5, 31, 30), (7, 0, 0), (8, 0, 0), (9, 2, 0)]
    alone = spark.createDataFrame([(5, text), (5, text), (5, text + " x")], SCHEMA)
    assert sorted(r.n_removed for r in substring_dedup.substring_duplicates(alone).collect()) in ([0, 0, 30], [0, 30, 30])
    assert substring_dedup.substring_duplicates(docs.limit(0)).collect() == []
    clash = docs.withColumn("row", docs.version).withColumn("starts", docs.version).withColumn("left", docs.version)
    out = substring_dedup.without_repeated_windows(clash)
    assert out.columns == clash.columns and out.count() == len(rows)
    texts = {r.version: r.text for r in out.collect()}
    assert texts[1] == text and texts[2] == "" and texts[4] == "x" and texts[5] is None and texts[8] == "é a"
    with pytest.raises(ValueError):
        substring_dedup.covered_words(docs, window=3)


def test_many_repeated_ids_are_joined(spark):
    rows = [(i // 2, f"a b {i}") for i in range(40)]
    found = substring_dedup.versions(spark.createDataFrame(rows, SCHEMA), most=3)
    assert found.count() == 40 and found.filter("version <> 0").count() == 40
