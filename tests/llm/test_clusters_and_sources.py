"""Ball k-means and the source audit against plain loops."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.oracle import assert_same, connect
from tidegrid.llm import ball_kmeans, divergence, shared
from tidegrid.llm import queries as Q

# --- ball k-means ---------------------------------------------------------------------


def lloyd(vectors: dict[int, list[float]], k: int, rounds: int, scale: int = 1024):
    q = {key: [int(np.floor(scale * x)) for x in v] for key, v in vectors.items()}
    first = sorted(q, key=lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest())[:k]
    centres = [q[i] for i in first]

    def assign():
        far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
        return {i: min((far(v, c), n) for n, c in enumerate(centres)) for i, v in q.items()}

    for _ in range(rounds):
        of = assign()
        for c in range(len(centres)):
            own = [q[i] for i in q if of[i][1] == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return assign(), centres


@pytest.mark.parametrize(("n", "k", "size", "spread"), [(400, 8, 3, 1.0), (60, 5, 2, 0.004), (5, 8, 4, 1.0), (200, 8, 1, 0.02)])
def test_equals_lloyd(spark, n, k, size, spread):
    rng = np.random.default_rng(n)
    vectors = {i * 7: rng.normal(scale=spread, size=size).astype("float32").tolist() for i in range(n)}  # small spreads: many ties
    of, centres = lloyd(vectors, k, 10)
    table = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    rows = ball_kmeans.ball_k_means(table, k=k, size=size).collect()
    assert {r.vec_id: (r.distance, r.cluster) for r in rows} == of
    inertia = Counter()
    for d, c in of.values():
        inertia[c] += d
    for r in rows:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centres[r.cluster])).encode()).hexdigest()


def test_balls_spare_comparisons():
    rng = np.random.default_rng(1)
    centres = rng.integers(-9000, 9000, (8, 16))
    q = (centres[rng.integers(0, 8, 5000)] + rng.integers(-700, 700, (5000, 16))).astype(np.int64)
    before, distance = ball_kmeans.nearest(q, centres)
    after = centres + rng.integers(-50, 50, centres.shape)
    cluster, far, compared = ball_kmeans.moved(q, before, distance, after, np.zeros(8, bool))
    expected = ball_kmeans.nearest(q, after)
    assert (cluster == expected[0]).all() and (far == expected[1]).all() and compared < 2 * len(q)
    # from any cluster, even a wrong one, the nearest centre is found
    wrong = ball_kmeans.moved(q, rng.integers(0, 8, 5000).astype(np.int32), distance, after, np.zeros(8, bool))
    assert (wrong[0] == expected[0]).all()


def test_resting_balls_keep_their_members():
    rng = np.random.default_rng(2)
    q = rng.integers(-3000, 3000, (2000, 4)).astype(np.int64)
    centres = q[:8].copy()
    cluster, distance = ball_kmeans.nearest(q, centres)
    for _ in range(30):
        balls = ball_kmeans.balls_of(q, cluster, distance, 8)
        new = ball_kmeans.centres_of(balls.astype(object), centres)
        resting = ball_kmeans.resting_balls(balls, centres, new)
        centres = new
        cluster, distance, _ = ball_kmeans.moved(q, cluster, distance, centres, resting)
        expected = ball_kmeans.nearest(q, centres)
        assert (cluster == expected[0]).all() and (distance == expected[1]).all()


def test_k_means_odd_inputs(spark, tmp_path):
    good = [[float(i), 1.0] for i in range(6)]
    rows = [(i, v, 0) for i, v in enumerate(good)] + [(3, [9.0, 9.0], 0), (None, [2.0, 2.0], 0), (20, None, 0), (21, [1.0], 0), (22, [1.0, None], 0), (23, [float("nan"), 1.0], 0), (24, [float("inf"), 1.0], 0), (25, [], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int")
    out = ball_kmeans.ball_k_means(table, k=3, size=2).collect()
    assert sorted(r.vec_id if r.vec_id is not None else -1 for r in out) == [-1, 0, 1, 2, 3, 3, 4, 5]
    assert ball_kmeans.ball_k_means(table.limit(0), size=2).collect() == []
    assert ball_kmeans.ball_k_means(table, size=77).collect() == []
    same = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(20)], "vec_id long, embedding array<float>")
    assert {(r.cluster, r.distance, r.inertia) for r in ball_kmeans.ball_k_means(same, size=2).collect()} == {(0, 0, 0)}
    with pytest.raises(Exception, match="after scaling"):
        ball_kmeans.ball_k_means(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<float>"), size=2).collect()


def test_only_the_last_round_is_kept(spark):
    place = shared.shared_dir(spark).removeprefix("file://")
    before = {d for d in os.listdir(place) if d.startswith("balls-")}
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, rng.normal(size=2).tolist()) for i in range(100)], "vec_id long, embedding array<float>")
    assert ball_kmeans.ball_k_means(table, size=2).count() == 100
    assert len({d for d in os.listdir(place) if d.startswith("balls-")} - before) == 1


# --- sources --------------------------------------------------------------------------


def audit(docs, least_docs, most_terms):
    """The contract, term by term."""
    counts, seen, groups = defaultdict(Counter), defaultdict(set), defaultdict(set)
    for i, (text, lang, source) in enumerate(docs):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            counts[lang, source][t] += 1
            seen[lang, t].add(i)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (la, t), d in seen.items() if la == lang and len(d) >= least_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())
        shares = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        q, p = shares(whole), {s: shares(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked[: None if part == "pair" else most_terms])}
    return out


SCHEMA = "text string, lang string, source string"


def random_docs(seed, sources):
    rng = random.Random(seed)
    words = ["the", "The", "naïve", "日本", "x", "it's", "a_b", "c3po", "É", "z" * 70, "\x7f", "[", "q@q", "ABC"] + [f"t{chr(97 + i)}" for i in range(12)]
    docs = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), rng.choice(["en", "de", None]), f"s{int(sources * rng.random() ** 3)}") for _ in range(300)]
    return docs + [(None, "en", "empty"), ("", "xx", "lone"), ("only here", "yy", None), ("A-b", "yy", "s1"), ("tà " * 3000, "en", None)]


@pytest.mark.parametrize("options", [{}, {"part_terms": 3}, {"block_sources": 2}, {"part_terms": 2, "block_sources": 1}])
def test_equals_plain_audit(spark, options):
    for seed, sources in ((1, 4), (2, 11)):
        docs = random_docs(seed, sources)
        rows = divergence.source_divergence(spark.createDataFrame(docs, SCHEMA).repartition(5), least_docs=4, most_terms=3, **options).collect()
        found = {tuple(r) for r in rows}
        assert len(rows) == len(found) and found == audit(docs, 4, 3)


def test_equal_hashes_of_other_bytes_are_told_apart():
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["ab", "abc", "b", "é", "cd", "dc", "longer", "lönger"]) for _ in range(50)).encode() for _ in range(6)]
    low, begin, end, _ = divergence.slices(texts)
    for digest in (lambda b: 7, len, xxhash.xxh3_64_intdigest):
        group, first = divergence.grouped(low, begin, end, digest)
        names = [low[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
        assert [names[first[g]] for g in group] == names and len(first) == len(set(names))


def test_shares_of_large_counts_are_exact(spark):
    n = np.array([0, 1, 10**10, 4 * 10**14, 8 * 10**15 - 2], np.int64)
    total = np.array([5, 3, 3 * 10**10 + 7, 10**15 + 1, 8 * 10**15], np.int64)
    expected = [1 + 10**9 * (a + 2) // b for a, b in zip(n.tolist(), total.tolist(), strict=True)]
    assert divergence.share(n, total).tolist() == expected
    from pyspark.sql import functions as F

    table = spark.createDataFrame(list(zip(n.tolist(), total.tolist(), expected, strict=True)), "n long, total long, expected long")
    assert all(r[0] == r[1] for r in table.select(divergence.share_column(F.col("n"), F.col("total")), "expected").collect())


def test_counter_flushes_what_it_holds():
    import pandas as pd

    frame = pd.DataFrame({"lang": ["a", "b"] * 50, "source": ["s"] * 100, "text": [f"w{chr(97 + i % 26)} common" for i in range(100)]})
    whole, small = divergence.Counter(1 << 20), divergence.Counter(8)
    whole.add(frame)
    parts = []
    for i in range(0, 100, 10):
        small.add(frame[i : i + 10])
        if small.full:
            parts += list(small.rows())
    parts += list(small.rows())
    keys = ["lang", "source", "term"]
    total = lambda fs: pd.concat(fs).groupby(keys)[["n", "docs"]].sum().to_dict()
    assert len(parts) > 2 and total(parts) == total(list(whole.rows()))


def test_audit_odd_inputs(spark):
    docs = spark.createDataFrame(random_docs(4, 3), SCHEMA)
    assert divergence.source_divergence(docs.limit(0)).collect() == []
    clash = docs.selectExpr("*", "1 as part", "2 as n", "3 as value", "4 as own", "5 as total")
    assert divergence.source_divergence(clash, least_docs=4).count() == divergence.source_divergence(docs, least_docs=4).count() > 0


@pytest.mark.parametrize("name", ["op11_recompression_dedup", "op12_ball_k_means", "op13_source_divergence"])
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(Q.queries()[name](spark, sf_dir), connect(sf_dir), Q.oracle_sql()[name])
