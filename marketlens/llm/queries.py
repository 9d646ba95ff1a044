"""The registered queries of the corpus operators and their DuckDB texts.

Each query applies its operator, with production parameters, to the whole table it is
made for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (best_fit, collocations, exact_dedup, licenses, mixing, packing, pii, prefix_trie, quality_classifier, quality_rules, simhash, token_counts,
                             url_filters)
from marketlens.llm.common import materialise, read_table
from marketlens.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op1_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, h AS text_sha256
    FROM d WINDOW g AS (PARTITION BY h)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


@query("op2_quality_rules", r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
                 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
                 row_number() OVER () AS k FROM t),
    g AS (SELECT k, i, list_slice(words, i, i + 7) AS win FROM (SELECT k, words, unnest(range(1, len(words) - 6)) AS i FROM w)),
    r AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, unnest(range(i, i + 8)) FROM
            (SELECT k, i, count(*) OVER (PARTITION BY k, win) AS c FROM g) WHERE c > 1) GROUP BY k),
    l AS (SELECT k, j, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
                 NOT regexp_matches(x, '[.!?:;…。！？؟।]["''”’»)\]]*[\x20\x09-\x0D]*\z') AS unended,
                 len(regexp_extract_all(x, '[|»›·•]|[\x20\x09][/>][\x20\x09]')) AS seps, len(regexp_extract_all(x, '[,，]')) AS commas,
                 len(regexp_extract_all(x, '[#*$%&]{2,}|[!?]{2,}')) AS noises,
                 len(regexp_extract_all(lower(x), 'cookie|privacy policy|terms of (use|service)|javascript|all rights reserved|lorem ipsum|subscribe|sign (in|up)|log ?in|click here|read more|share (this|on)|skip to|powered by')) AS phrases
          FROM (SELECT k, unnest(lines) AS x, generate_subscripts(lines, 1) AS j FROM w)),
    v AS (SELECT k, j, x, n, unended, seps >= 3 AND seps * 4 >= n OR unended AND seps + commas >= 3 AND (seps + commas) * 4 >= n AS navigation,
                 noises >= 2 AND noises * 100 >= n * 30 AS noise, phrases >= 1 AND (n <= 12 OR phrases * 8 >= n) AS boilerplate FROM l),
    s AS (SELECT k, count(*) AS n_lines, count(*) FILTER (unended) AS u, count(*) FILTER (navigation) AS m, count(*) FILTER (noise) AS o,
                 count(*) FILTER (boilerplate) AS b, sum(n) FILTER (unended OR navigation OR noise OR boilerplate) AS lost,
                 string_agg(x, chr(10) ORDER BY j) FILTER (NOT (unended OR navigation OR noise OR boilerplate)) AS clean FROM v GROUP BY k),
    f AS (SELECT doc_id, len(words)::BIGINT AS n_words, (length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
                 len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
                 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
                 coalesce(s.n_lines, 0) AS n_lines, coalesce(u, 0) AS n_unended_lines, coalesce(m, 0) AS n_navigation_lines,
                 coalesce(o, 0) AS n_noise_lines, coalesce(b, 0) AS n_boilerplate_lines, coalesce(lost, 0)::BIGINT AS n_lost_words,
                 sha256(coalesce(clean, '')) AS clean_sha256
          FROM w LEFT JOIN r USING (k) LEFT JOIN s USING (k)),
    x AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
    SELECT *, NOT base_failed AND 100 * n_lost_words <= 50 * n_words AS kept FROM x
""")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(read_table(spark, sf_dir, "documents"))
    return judged.withColumn("clean_sha256", F.sha2("clean_text", 256)).drop("clean_text")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op6_simhash")
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query("op9_mixing", r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                      md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS ticket FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS w FROM d GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source) AS k,
                 sum(n) OVER () - 3 * coalesce(sum(n) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(w) OVER (ORDER BY 3.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM s),
    l AS (SELECT *, rest::DOUBLE / share::DOUBLE AS level FROM o),
    c AS (SELECT k, level FROM l WHERE NOT w * level > 3 * n ORDER BY k LIMIT 1),
    t AS (SELECT source, n, CASE WHEN l.k < c.k THEN (3 * n)::DOUBLE ELSE w * c.level END AS target FROM l, c),
    q AS (SELECT *, floor(target + 0.5)::BIGINT AS quota FROM t),
    p AS (SELECT doc_id, size, n, target, quota, ticket, CASE WHEN n = 0 THEN 0 ELSE quota // n END AS times,
                 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ticket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
          FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
    SELECT doc_id, size, n AS source_size, target,
           (size * (times + CASE WHEN 2 * before + size <= 2 * (quota - times * n) AND quota > times * n THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
""")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents")).drop("detections")


@query("op7_url_filters")
def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(read_table(spark, sf_dir, "pages"))


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, repeated lines were taken out and toxic documents were deleted."""
    counted = materialise(token_counts.counts(read_table(spark, sf_dir, "documents")))
    toxic = read_table(spark, sf_dir, "labels").where("toxic = 1")
    folder = token_counts.scratch(spark)
    try:
        return materialise(token_counts.maintain(counted, toxic, folder))
    finally:
        files.remove(spark, folder)


@query("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    plain = F.transform("added", lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                        pii.spans_text(F.concat("base", plain)).alias("spans"))


@query("op11_best_fit")
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack(read_table(spark, sf_dir, "documents"))


@query("op12_prefix_trie", r"""
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS said, turn
               FROM conversations WHERE conv_id IS NOT NULL),
    o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS nth, said,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS words FROM t),
    c AS (SELECT conv_id, conv_id - conv_id % 20 AS family,
                 xor(4294967295, list_reduce(list_prepend(4294967295, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
                     lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda z, i: xor(z >> 1, 3988292384 * (z & 1))))) % 4 AS h
          FROM (SELECT DISTINCT conv_id FROM o)),
    r AS (SELECT c.conv_id, 0 AS own, nth, said, words FROM c JOIN o ON o.conv_id = family AND nth <= h
          UNION ALL SELECT conv_id, 1, nth, said, words FROM c JOIN o USING (conv_id) WHERE nth > h),
    s AS (SELECT conv_id, list(said ORDER BY own, nth) AS seq, list(words ORDER BY own, nth) AS words FROM r GROUP BY conv_id
          UNION ALL SELECT conv_id, [], [] FROM c WHERE conv_id NOT IN (SELECT conv_id FROM r)),
    p AS (SELECT conv_id, d, seq[1:d] AS node, len(seq) = d AS ends, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
          FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM s)),
    g AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n, any_value(w) AS w,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node, d),
    k AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS children FROM g WHERE d > 0 GROUP BY ALL),
    f AS (SELECT g.*, coalesce(children, 0) AS children FROM g LEFT JOIN k USING (node, d)),
    a AS (SELECT node[1:x] AS node, x AS d, count(*) FILTER (children = 0) AS leaves, sum((n - 1) * w)::BIGINT AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS x FROM f) GROUP BY ALL)
    SELECT f.conv_id, f.d AS depth, above.conv_id AS parent_conv_id, f.n AS n_convs, f.children AS n_children, leaves AS n_leaves,
           saved AS saved_tokens, f.ends_sha256
    FROM f JOIN a USING (node, d) LEFT JOIN g above ON f.d > 0 AND above.node = f.node[1:f.d - 1] AND above.d = f.d - 1
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


@query("op13_collocations", r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
          FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
    g AS (SELECT lang, unnest(flatten([[w[i:i + k - 1] FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 5)])) AS p FROM w),
    f AS (SELECT lang, p, count(*) AS f FROM g GROUP BY lang, p HAVING count(*) >= 30),
    c AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
    s AS (SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score
          FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    i AS (SELECT lang, p, max(f) AS longer FROM (
              SELECT lang, f, unnest(flatten([[p[j:j + m - 1] FOR j IN range(1, len(p) - m + 2)] FOR m IN range(2, len(p))])) AS p
              FROM f WHERE len(p) > 2) GROUP BY ALL),
    o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, p) WHERE longer IS NULL OR 100 * longer < 80 * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
           array_to_string(p, ' ') AS phrase, a, l, r, n, score
    FROM o JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))
