"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, on driver and executors alike."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, window=4096)


def op2_factorisation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_language_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(_table(spark, sf_dir, "documents"))


def op4_crf_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(_table(spark, sf_dir, "documents"))


def op5_suffix_group_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_duplicates

    return suffix_duplicates(_table(spark, sf_dir, "documents"), length=100)


def op6_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def op8_setsketch_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, percent=80)


#: Added to the table by op9's contract: control strings inside texts.
SELF_TEST = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op9_chat_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chat_digests

    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame(SELF_TEST, "conv_id long, turn long, role string, text string")
    found = chat_digests(rows.unionByName(own), vocabulary("byte_bpe_50k.json"))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_sentencepiece_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import verify_pieces

    return verify_pieces(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op11_recompression_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_duplicates

    return substring_duplicates(_table(spark, sf_dir, "documents"), window=20)


def op12_ball_k_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ball_kmeans import ball_k_means

    return ball_k_means(_table(spark, sf_dir, "embeddings"), k=8, rounds=10, size=64, scale=1024, seed=3)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"), least_docs=10, most_terms=10)


def _k_means_sql(rounds: int = 10) -> str:
    """Rounds as a chain of steps: assignment to the nearest centre, then floored means."""
    steps = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS INTEGER) AS c, q AS m FROM v QUALIFY c < 8)"""]  # fmt: skip
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, min(struct_pack(d := d, c := c)) AS b FROM (
            SELECT vec_id, q, c, CAST(list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{i} o LEFT JOIN (SELECT c, list(f ORDER BY k) AS m FROM (
                SELECT c, k, CAST((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS f FROM (SELECT b.c AS c, unnest(range(1, 65)) AS k, unnest(q) AS x FROM a{i}) GROUP BY c, k) GROUP BY c) n ON n.c = o.c)""")
    return f"""WITH {", ".join(steps)} SELECT vec_id, b.c AS cluster, b.d AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} o ON o.c = b.c"""


def exact_personal_data_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4's result."""
    return op4_crf_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def exact_edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7's result."""
    return op7_bottom_k_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith(("op", "exact_")) and callable(f)}


SQL = {
    "op5_suffix_group_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS pos FROM d),
        s AS (SELECT doc_id, pos, substring(h, 2 * pos + 1, 2) AS b, CASE WHEN 2 * pos + 200 <= length(h) THEN substring(h, 2 * pos + 1, 200) END AS w FROM p),
        r AS (SELECT doc_id, pos, b, w IS NOT NULL AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS later FROM s),
        c AS (SELECT doc_id, pos, b, max(CAST(later AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
        e AS (SELECT *, gone > coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS opens FROM c),
        k AS (SELECT doc_id, count(*) AS n_bytes, sum(gone) AS n_removed, count(*) FILTER (opens) AS n_spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY pos) FILTER (gone = 0), ''))) AS kept_sha256 FROM e GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
    """,
    "op8_setsketch_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM b JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
        u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS node, doc_id AS seen FROM w UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.seen),
        c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n USING (doc_id)
    """,
    "op9_chat_masks": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        e AS (SELECT *, length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS n FROM t)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id
    """,
    "op11_recompression_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
        s AS (SELECT doc_id, pos, w[pos] AS b, CASE WHEN pos + 19 <= len(w) THEN array_to_string(w[pos:pos + 19], ' ') END AS k FROM p),
        r AS (SELECT doc_id, pos, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS later FROM s),
        c AS (SELECT doc_id, pos, b, max(CAST(later AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
        g AS (SELECT doc_id, sum(gone) AS n_removed, string_agg(b, ' ' ORDER BY pos) FILTER (gone = 0) AS kept FROM c GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
    """,
    "exact_personal_data_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        m AS (SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
            regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+') AS card, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]') AS phone FROM t),
        d AS (SELECT doc_id, email, list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(TRY_CAST(y AS INTEGER), 0) > 255)) = 0) AS ip,
            list_filter(list_transform(card, lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))), lambda x: length(x) BETWEEN 12 AND 19) AS card,
            list_filter(phone, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15) AS phone FROM m)
        SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email, CAST(len(ip) AS BIGINT) AS n_ip,
            CAST(len(list_filter(card, lambda x: list_sum(list_transform(range(0, length(x)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(x[i + 1] AS INTEGER) WHEN CAST(x[i + 1] AS INTEGER) > 4 THEN 2 * CAST(x[i + 1] AS INTEGER) - 9 ELSE 2 * CAST(x[i + 1] AS INTEGER) END)) % 10 = 0)) AS BIGINT) AS n_card,
            CAST(len(phone) AS BIGINT) AS n_phone FROM d
    """,
    "exact_edited_texts": """
        WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, length(t) AS n, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS after FROM t)
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(substring(t, 1, CAST(n - n // 4 AS BIGINT)) || substring(after, 1, CAST(n // 4 AS BIGINT))) AS edited_sha256 FROM n
    """,
    "op12_ball_k_means": _k_means_sql(),
    "op13_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
        k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
        m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
        x AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS s, sum(n) OVER (PARTITION BY lang, term) AS ln, sum(n) OVER (PARTITION BY lang) AS ls FROM m),
        p AS (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (s + 2 * v) AS BIGINT) AS p, CAST(1 + (CAST(1000000000 AS HUGEINT) * (ln + 2)) // (ls + 2 * v) AS BIGINT) AS q FROM x JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
    """,
    "op6_bit_sliced_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
