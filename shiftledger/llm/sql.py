"""The same results in DuckDB SQL, for the queries that SQL expresses in reasonable time."""

from shiftledger.llm.secrets import BASE, RULES

SPACES = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"


def _secrets() -> str:
    """Matches of each rule in order; a match starts after the pieces and matches before it."""
    quoted = lambda r: ("(?i)" if r.ignore_case else "") + r.pattern.replace("'", "''")
    parts = " UNION ALL ".join(f"""
        SELECT doc_id, n, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, '{quoted(r)}') AS gaps,
               regexp_extract_all(t, '{quoted(r)}') AS hits, regexp_extract_all(t, '{quoted(r)}', {r.group}) AS kept FROM d""" for k, r in enumerate(RULES))
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listed = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k){}, '')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
    m AS ({parts}),
    each AS (SELECT n, k, kind, least, gaps, hits, kept, unnest(range(1, len(hits) + 1)) AS i FROM m WHERE len(hits) > 0),
    s AS (SELECT n, k, kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a,
                 length(hits[i]) AS size FROM each WHERE length(kept[i]) >= least),
    p AS (SELECT n, k, kind, CAST(a AS BIGINT) AS a, CAST(a + size AS BIGINT) AS b FROM s)
    SELECT any_value(d.doc_id) AS doc_id, {counts}, sha256({listed.format(f" FILTER (k < {len(BASE)})")}) AS base_sha256, {listed.format(" FILTER (kind IS NOT NULL)")} AS spans
    FROM d LEFT JOIN p USING (n) GROUP BY n"""


SUBSTRINGS = f"""
    WITH d AS (SELECT DISTINCT doc_id, text, {WORDS} AS w FROM documents),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text) AS k FROM d),
    s AS (SELECT k, doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 18)) AS i FROM n WHERE len(w) >= 20)),
    later AS (SELECT k, i FROM s QUALIFY rank() OVER (PARTITION BY s ORDER BY k, i) > 1),
    gone AS (SELECT DISTINCT k, unnest(range(i, i + 20)) AS j FROM later),
    kept AS (SELECT v.k, count(gone.j) AS n_removed, string_agg(v.x, ' ' ORDER BY v.j) FILTER (gone.j IS NULL) AS t
             FROM (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM n) v LEFT JOIN gone USING (k, j) GROUP BY v.k)
    SELECT o.doc_id, CAST(len(n.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM documents o JOIN n ON o.doc_id IS NOT DISTINCT FROM n.doc_id AND o.text IS NOT DISTINCT FROM n.text LEFT JOIN kept USING (k)"""

MIX = f"""
    WITH w AS (SELECT doc_id, source, text, {WORDS} AS w FROM documents),
    f AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
                 greatest(0.05::DOUBLE, len(list_distinct(w))::DOUBLE / greatest(len(w), 1))
                 * greatest(0.05::DOUBLE, 1 - len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::DOUBLE / greatest(len(w), 1)) AS weight,
                 (CAST('0x' || substr(md5(concat_ws(':', doc_id, coalesce(text, ''))), 1, 12) AS BIGINT)::DOUBLE + 0.5) / 281474976710656 AS u FROM w),
    r AS (SELECT *, 1 - exp(ln(u) / weight) AS at FROM f),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
    x AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3)::INT + 1] AS w FROM s),
    y AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER o, 0))
                    / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level, row_number() OVER (ORDER BY 2 * source_size / w, source IS NULL, source) AS place
          FROM x WINDOW o AS (ORDER BY 2 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT *, level > 2 * source_size / w AS stopped FROM y),
    c AS (SELECT *, min_by(level, place) FILTER (NOT stopped) OVER () AS common FROM z),
    t AS (SELECT source, source_size, CASE WHEN stopped THEN 2 * source_size::DOUBLE ELSE least(w * common, 2 * source_size::DOUBLE) END AS target FROM c),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
    p AS (SELECT r.doc_id, r.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
                 sum(r.size) OVER (PARTITION BY r.source ORDER BY r.at, r.doc_id, r.size ROWS UNBOUNDED PRECEDING) AS upto
          FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
    SELECT query_id, CAST(row_number() OVER o AS INT) AS rank, vec_id, score FROM s
    WINDOW o AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5"""

def _crc_table() -> str:
    """The CRC register after each byte, by the polynomial."""
    c = list(range(256))
    for _ in range(8):
        c = [x >> 1 ^ 0xEDB88320 * (x & 1) for x in c]
    return f"CAST({c} AS UBIGINT[])"


def _resampling() -> str:
    """Runs of words as strings; the CRC of the distinct ones byte by byte; the rest by aggregation."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    w = f"list_filter(string_split_regex({low}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    runs = "flatten(list_transform([1, 2, 3], lambda k: list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))"
    return f"""
    WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS n, {w} AS w FROM documents),
    b AS (SELECT {w} AS w FROM benchmark),
    f AS MATERIALIZED (SELECT n, unnest({runs}) AS s FROM d),
    g AS (SELECT unnest({runs}) AS s FROM b),
    u AS MATERIALIZED (SELECT s, row_number() OVER () AS id, hex(encode(s)) AS x FROM (SELECT s FROM f UNION SELECT s FROM g)),
    q AS (SELECT CAST(i AS BIGINT) AS i, t FROM (SELECT unnest(range(256)) AS i, unnest({_crc_table()}) AS t)),
    z AS (SELECT id, x, 1 AS p, 4294967295::UBIGINT AS c FROM u UNION ALL
          SELECT id, x, p + 2, xor(c >> 8, t) FROM z JOIN q ON i = xor(c & 255, ('0x' || substr(x, p, 2))::UBIGINT)::BIGINT WHERE p < length(x)),
    c AS MATERIALIZED (SELECT s, xor(z.c, 4294967295::UBIGINT) % 10000 AS k FROM z JOIN u USING (id) WHERE p > length(u.x)),
    fs AS (SELECT k, count(*) AS s FROM f JOIN c USING (s) GROUP BY k),
    gs AS (SELECT k, count(*) AS t FROM g JOIN c USING (s) GROUP BY k),
    a AS (SELECT (SELECT sum(s) FROM fs)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM gs), 0)::DOUBLE AS t_all),
    e AS (SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
          FROM fs LEFT JOIN gs USING (k), a),
    v AS (SELECT n, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN c USING (s) JOIN e USING (k) GROUP BY n),
    h AS (SELECT n, (('0x' || substr(sha256(concat('42:', doc_id)), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE AS u FROM d),
    r AS (SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM d JOIN h USING (n) LEFT JOIN v USING (n)),
    o AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) END AS place,
                 5 * count(*) FILTER (words >= 20) OVER () // 100 AS many FROM r)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= many THEN place END AS rank FROM o"""


JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS n,
        list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACES}'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
    c AS (SELECT n, count(*) AS size FROM s GROUP BY n),
    i AS (SELECT a.n AS a, b.n AS b, count(*) AS same FROM s a JOIN s b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n),
    l AS MATERIALIZED (SELECT a, b FROM i JOIN c x ON x.n = a JOIN c y ON y.n = b WHERE 100 * same >= 85 * (x.size + y.size - same)),
    r AS (SELECT n, n AS m FROM d UNION SELECT r.n, l.b FROM r JOIN l ON r.m = l.a),
    k AS (SELECT r.n, min(d.doc_id) AS component_id FROM r JOIN d ON d.n = r.m GROUP BY r.n)
    SELECT doc_id, coalesce(size, 0) AS n_shingles, component_id FROM d JOIN k USING (n) LEFT JOIN c USING (n)"""


SQL: dict[str, str] = {"op1_secret_scan": _secrets(), "op4_substring_dedup": SUBSTRINGS, "op7_source_mix": MIX, "op10_exact_top_k": TOP_K,
                       "op11_importance_resampling": _resampling(), "op13_ngram_jaccard_join": JACCARD}
