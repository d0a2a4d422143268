"""The thin queries: each operator over its whole table, with the digest columns the checks read."""

from __future__ import annotations

import posixpath
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from . import (
    bpe_fst,
    centroids,
    decision_list,
    decontaminate,
    divergence,
    license_scan,
    line_dedup,
    near_dup,
    piece_bpe,
    quality_fm,
    shard_tree,
    token_files,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(posixpath.join(directory, f"{name}.parquet"))


def query(key: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


@query(
    "op1_winnowing_decontamination",
    r"""WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    item_at AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(greatest(1, len(w) - 9))) AS s FROM item WHERE len(w) > 0),
    item_window AS (SELECT DISTINCT item_id, size, array_to_string(w[s + 1 : s + size], ' ') AS win FROM item_at),
    sizes AS (SELECT DISTINCT size FROM item_window),
    doc_at AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS s FROM doc, sizes WHERE len(w) >= size),
    doc_window AS (SELECT doc_id, size, s, array_to_string(w[s + 1 : s + size], ' ') AS win FROM doc_at),
    found AS (SELECT doc_id, d.size, s, item_id FROM doc_window d JOIN item_window i ON d.size = i.size AND d.win = i.win),
    places AS (SELECT DISTINCT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, size, s FROM found)),
    hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY 1),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS list FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM found) GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def _(spark: SparkSession, directory: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", "n_items", digest, "contaminated")


@query(
    "op5_minhash_near_dedup",
    r"""WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, least(len(w), 4) AS size, unnest(range(greatest(1, len(w) - 3))) AS s FROM doc WHERE len(w) > 0),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[s + 1 : s + size], ' ')) AS x FROM places),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
    common AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
    link AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
    both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM doc UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
    low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN n USING (doc_id)""",
)
def _(spark: SparkSession, directory: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, directory, "documents"), shingle=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


@query("op8_decision_list_rules")
def _(spark: SparkSession, directory: str) -> DataFrame:
    judged = decision_list.judge(table(spark, directory, "documents"), table(spark, directory, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(F.col("id").alias("doc_id"), *base, "base_failed", "kept")


@query("op2_factorisation_machine_quality")
def _(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    machine = quality_fm.train(documents, table(spark, directory, "labels"))
    scored = quality_fm.score(documents, machine)
    return scored.select(
        F.col("id").alias("doc_id"),
        quality_fm.held_out().alias("held_out"),
        "score",
        (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op3_bpe_transducer")
def _(spark: SparkSession, directory: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_bytes()
    done = bpe_fst.round_trip(table(spark, directory, "documents"), ranks, public_tokenizers.PATTERN)
    return done.withColumnRenamed("id", "doc_id")


@query("op6_hash_tree_sharding")
def _(spark: SparkSession, directory: str) -> DataFrame:
    placed = shard_tree.assign(table(spark, directory, "documents"), 24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: fixed values: the rules of the check
RULES = [
    url_filter.Rule("net", "/", "block"),
    url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"),
    url_filter.Rule("org", "/fr/", "allow"),
]


@query(
    "op10_url_redirect_equivalence",
    # links as browsers resolve them, then dot segments folded away
    r"""WITH RECURSIVE rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
    read AS (SELECT page_id, html, url, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([^#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([^#]*)', 2, 's') AS path,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)([^#]*)', 3, 's') AS query FROM pages),
    keyed AS (SELECT *, '://' || host || CASE WHEN path = '' THEN '/' ELSE list_reduce(list_prepend('', string_split(path, '/')[2:]), lambda a, x: CASE x WHEN '.' THEN a
        WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END END || query AS key FROM read),
    tags AS (SELECT host, path, key, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is')) AS t FROM keyed WHERE url LIKE '%://%'),
    link AS (SELECT key, host, path, replace(CASE WHEN regexp_matches(t, '\brel\s*=\s*["'']?canonical\b', 'i') THEN regexp_extract(t, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
        WHEN regexp_matches(t, '\bhttp-equiv\s*=\s*["'']?refresh\b', 'i') THEN regexp_extract(t, '\bcontent\s*=\s*["'']?[^>]*?\burl\s*=\s*''?([^"''\s>]+)', 1, 'i') END, '&amp;', '&') AS l FROM tags),
    target AS (SELECT key, CASE WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL WHEN l LIKE '//%' THEN ':' || l WHEN l LIKE '/%' THEN '://' || host || l
        WHEN l LIKE '?%' THEN '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || l WHEN l LIKE '#%' THEN key
        ELSE '://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1, 's') END || l END AS t FROM link WHERE l <> ''),
    parts AS (SELECT key, translate(regexp_extract(t, '^.*?://([^/?#]*)([^?#]*)([^#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(t, '^.*?://([^/?#]*)([^?#]*)([^#]*)', 2, 's') AS path, regexp_extract(t, '^.*?://([^/?#]*)([^?#]*)([^#]*)', 3, 's') AS query FROM target WHERE t IS NOT NULL),
    edge AS (SELECT key AS a, '://' || host || CASE WHEN path = '' THEN '/' ELSE list_reduce(list_prepend('', string_split(path, '/')[2:]), lambda a, x: CASE x WHEN '.' THEN a
        WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END) || CASE WHEN regexp_matches(path, '/\.\.?$') THEN '/' ELSE '' END END || query AS b FROM parts),
    both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
    reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
    judged AS (SELECT a, b, regexp_extract(b, '^.*?://([^/?#]*)([^?#]*)([^#]*)', 1, 's') AS host, regexp_extract(b, '^.*?://([^/?#]*)([^?#]*)([^#]*)', 2, 's') AS path FROM reach),
    alias AS (SELECT DISTINCT a FROM (SELECT a, b, arg_max(v, length(h || p)) AS v FROM judged JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY a, b) WHERE v = 'block'),
    own AS (SELECT page_id, url, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM read LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
    SELECT own.page_id, own.host, own.path, rule, coalesce(v, CASE WHEN a IS NOT NULL THEN 'block' END, 'allow') AS verdict
    FROM own JOIN keyed USING (page_id) LEFT JOIN alias ON a = keyed.key AND keyed.url LIKE '%://%'""",
)
def _(spark: SparkSession, directory: str) -> DataFrame:
    judged = url_filter.judge(table(spark, directory, "pages"), RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _license_sql() -> str:
    """Every template at every shift, as plain SQL; the notices and phrases are the only thing shared with the operator."""
    rows = ", ".join(
        f"({t}, '{x.label}', {q}, '{w}', {x.key_at}, {len(x.key.split())})"
        for t, x in enumerate(license_scan.TEMPLATES)
        for q, w in enumerate(x.words)
    )
    return rf"""WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    tpl(t, label, q, word, key_at, key_len) AS (VALUES {rows}),
    size AS (SELECT count(*) AS n FROM doc),
    df AS (SELECT word, count(*) AS c FROM (SELECT unnest(list_distinct(w)) AS word FROM doc) WHERE word IN (SELECT word FROM tpl) GROUP BY 1),
    weight AS (SELECT DISTINCT tpl.word, ln((1 + n) / (1 + coalesce(c, 0))) + 1e-9 AS x FROM tpl LEFT JOIN df USING (word), size),
    total AS (SELECT t, sum(x) AS total FROM tpl JOIN weight USING (word) GROUP BY 1),
    place AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM doc),
    hit AS (SELECT doc_id, t, any_value(label) AS label, any_value(key_len) AS key_len, sum(x) AS s, count(*) FILTER (q >= key_at AND q < key_at + key_len) AS k
        FROM place JOIN tpl USING (word) JOIN weight USING (word) GROUP BY doc_id, t, p - q),
    found AS (SELECT doc_id, label, least(s / total, 1.0) AS share FROM hit JOIN total USING (t) WHERE k = key_len AND s / total >= 0.7),
    base AS (SELECT doc_id, 'mit' AS label, unnest(list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license')) - 1 AS p FROM doc
        UNION ALL SELECT doc_id, 'apache', unnest(list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license')) - 1 FROM doc
        UNION ALL SELECT doc_id, 'gpl', unnest(list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license')) - 1 FROM doc),
    places AS (SELECT doc_id, count(*) AS n, min(p) AS a, max(p) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS list FROM base GROUP BY 1),
    both_labels AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS list FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM found) GROUP BY 1),
    best AS (SELECT doc_id, max(share) AS share FROM found GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(places.n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word, coalesce(places.list, '') AS base_labels,
        coalesce(both_labels.list, '') AS labels, CASE WHEN places.n > 0 THEN 1.0::DOUBLE ELSE round(coalesce(share, 0), 9)::DOUBLE END AS score
    FROM doc LEFT JOIN places USING (doc_id) LEFT JOIN both_labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


@query("op9_license_positional_index", _license_sql())
def _(spark: SparkSession, directory: str) -> DataFrame:
    found = license_scan.scan(table(spark, directory, "documents"))
    counts = ["n_words", "n_base", "first_word", "last_word"]
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return found.select(F.col("id").alias("doc_id"), *counts, *joined, F.round("score", 9).alias("score"))


@query(
    "op7_line_deletion_neighbourhood",
    """WITH doc AS (SELECT doc_id, {'d': doc_id, 'h': ('0x' || left(md5(text), 15))::BIGINT} AS d, text FROM documents),
    l AS (SELECT d, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
            FROM (SELECT DISTINCT d, text FROM doc WHERE text IS NOT NULL)),
    b AS (SELECT d, i, raw, trim(raw, ' ' || chr(9) || chr(13)) AS body FROM l),
    f AS (SELECT body, min({'d': d, 'i': i}) AS first, length(body) AS n FROM b WHERE body <> '' GROUP BY body),
    m AS (SELECT body, first, n, unnest([n, n - 1]) AS m FROM f WHERE n >= 20),
    half AS (SELECT body, first, n, m, 'left' AS side, left(body, m // 2) AS part FROM m
        UNION ALL SELECT body, first, n, m, 'right', right(body, m - m // 2) FROM m),
    pair AS (SELECT DISTINCT x.body AS a, y.body AS e, x.n AS na, y.n AS ne FROM half x
        JOIN half y ON x.m = y.m AND x.side = y.side AND x.part = y.part AND y.first < x.first AND abs(x.n - y.n) <= 1),
    near AS (SELECT DISTINCT a FROM pair WHERE CASE WHEN na = ne THEN len(list_filter(range(1, na + 1), lambda k: a[k] <> e[k])) = 1
        WHEN na > ne THEN len(list_filter(range(1, na + 1), lambda k: left(a, k - 1) || substr(a, k + 1) = e)) > 0
        ELSE len(list_filter(range(1, ne + 1), lambda k: left(e, k - 1) || substr(e, k + 1) = a)) > 0 END),
    kept AS (SELECT d, i, raw FROM b LEFT JOIN f USING (body) LEFT JOIN near ON a = body WHERE body = '' OR (first = {'d': d, 'i': i} AND a IS NULL)),
    t AS (SELECT d, string_agg(raw, chr(10) ORDER BY i) AS text, count(*) AS n FROM kept GROUP BY 1)
    SELECT doc_id, CASE WHEN doc.text IS NULL THEN 0 ELSE coalesce(n, 1) END::BIGINT AS n_lines, sha256(coalesce(t.text, '')) AS text_sha256
    FROM doc LEFT JOIN t ON t.d = doc.d AND doc.text IS NOT NULL""",
)
def _(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    return line_digest(line_dedup.dedup_lines(documents))


def line_digest(kept: DataFrame) -> DataFrame:
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", lines.cast("long").alias("n_lines"), digest.alias("text_sha256"))


@query("op4_range_coded_token_files")
def _(spark: SparkSession, directory: str) -> DataFrame:
    tokenizer = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()
    path = scratch_path(spark, "tokens")
    token_files.write(table(spark, directory, "documents"), path, tokenizer, pattern=public_tokenizers.PATTERN)
    return token_files.read_documents(spark, path).withColumnRenamed("id", "doc_id")


def _cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """Every distance in every round, from the vectors; dot products of whole numbers are exact in a double here."""
    steps = [
        """v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS mid FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM v
            WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))""",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS best FROM (SELECT r, vec_id, v, c,
            list_dot_product(v, v) - 2 * list_dot_product(v, mid) + list_dot_product(mid, mid) AS d FROM v, c{n}) GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m, c{n}.mid) AS mid FROM c{n} LEFT JOIN (SELECT c, list(f ORDER BY i) AS m FROM (
            SELECT c, i, floor(sum(x) / count(*)) AS f FROM (SELECT best.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) USING (c))"""
            )
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, best.c::INTEGER AS cluster, best.d::BIGINT AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
        (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(mid, lambda x: x::BIGINT), ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON c{rounds}.c = best.c"""


@query("op11_incremental_centroids", _cluster_sql())
def _(spark: SparkSession, directory: str) -> DataFrame:
    found = centroids.cluster(table(spark, directory, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")).cast("binary"), 256)
    kept = ["cluster", "distance", "cluster_inertia", "inertia"]
    return found.select(F.col("id").alias("vec_id"), *kept, digest.alias("centroid_sha256"))


@query(
    "op12_source_divergence_audit",
    r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS MATERIALIZED (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
    k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(*) >= 10),
    s AS MATERIALIZED (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    lang_size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
    source_size AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN s USING (lang, source) GROUP BY ALL),
    p AS MATERIALIZED (SELECT lang, z.source, k.term, coalesce(s.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(s.n, 0) + 2) // (z.total + 2 * v) AS p,
        1 + 1000000000::HUGEINT * (k.n + 2) // (l.total + 2 * v) AS q
        FROM k JOIN source_size z USING (lang) JOIN lang_size l USING (lang) LEFT JOIN s USING (lang, source, term)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term)
        WHERE a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
    term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
    every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every) WHERE part = 'pair' OR rank <= 10""",
)
def _(spark: SparkSession, directory: str) -> DataFrame:
    return divergence.audit(table(spark, directory, "documents"))


@query("op13_sentencepiece_merge_rounds")
def _(spark: SparkSession, directory: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return piece_bpe.round_trip(table(spark, directory, "documents"), model).withColumnRenamed("id", "doc_id")
