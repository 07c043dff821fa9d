"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import decontaminate, html_text, jaccard, nearest, packing, phrases, quality, sharding, simhash, source_audit, suffix_dedup, token_counts, url_filter
from shelfwise.sources.scratch import new_path, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def registered(query):
    QUERIES[query.__name__] = query
    return query


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: (host, path, verdict)
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@registered
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("host", "path", "verdict"), rule)]) for rule in URL_RULES])
    rules = spark.range(1).select(F.inline(rows))
    return (url_filter.judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), rules)
            .select("page_id", "host", "path", "rule", "verdict"))


SQL["op4_url_filters"] = """
WITH parted AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                       'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages),
rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                          ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
judged AS (
    SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
    FROM (SELECT DISTINCT host, path FROM parted), rules
    WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
    GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parted LEFT JOIN judged USING (host, path)
"""


@registered
def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    slim = staged(sharding.in_slots(docs).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
                  .select("doc_id", "virtual_slot", "size", "text_crc32", sharding.row_number_of().alias("number")), "in-slots")
    heavy = sharding.heavy_slots(sharding.slot_loads(slim))
    slotted = sharding.dealt_out(slim, heavy, "number")
    path = new_path(spark, "slot-map")
    sharding.write_map(sharding.first_map(sharding.slot_loads(slotted), 16, heavy), path)
    return (sharding.placed(slotted, sharding.read_map(spark, path), ["doc_id", "size", "text_crc32"])
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@registered
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.with_token_counts(docs, byte_bpe()).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@registered
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe(), keep_ids=False)


@registered
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.with_scores(docs.withColumn("held_out", quality.held_out()), model).select("doc_id", "held_out", "score", "predicted")


@registered
def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@registered
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return (decontaminate.with_contamination(docs, _table(spark, sf_dir, "benchmark"), unnamed_items=True)
            .select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))


SQL["op1_decontamination"] = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE text IS NOT NULL),
phrases AS (
    SELECT DISTINCT item_id, unnest(CASE WHEN len(w) < 13 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS phrase,
        least(len(w), 13) AS n
    FROM item_words WHERE len(w) > 0),
doc_words AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
starts AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM phrases)),
hits AS (SELECT DISTINCT r, i, s.n, item_id
         FROM (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM starts) s
         JOIN phrases p ON s.phrase = p.phrase AND s.n = p.n),
words_hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM doc_words LEFT JOIN words_hit USING (r) LEFT JOIN items USING (r)
"""


@registered
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.NGramJaccard(n=4, share=85).join(_table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


SQL["op3_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents),
sets AS (
    SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
    FROM words),
members AS (SELECT r, len(s) AS n, unnest(s) AS m FROM sets),
links AS (SELECT x.r AS a, y.r AS b FROM members x JOIN members y ON x.m = y.m AND x.r <> y.r
          WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n)
          GROUP BY x.r, y.r, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reached(r, root) AS (SELECT r, r FROM sets UNION SELECT b, root FROM links JOIN reached ON a = r)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reached ON s.r = reached.r JOIN sets o ON o.r = reached.root GROUP BY s.r, s.doc_id, s.s
"""


@registered
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the contract, strings of 400 bytes; ``text`` is without repeated passages of over 50 words as well, as in the pipeline."""
    return (suffix_dedup.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=True, words=51, less="text")
            .select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "text"))


@registered
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.with_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@registered
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


SQL["op11_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, c, array_to_string(w[1:c], ' ') AS x, array_to_string(w[c + 1:k], ' ') AS y
         FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (
    SELECT cuts.lang, cuts.k, cuts.phrase, a, c, fx.f AS l, fy.f AS r,
           CAST((1000000::HUGEINT * a * a) // (fx.f::HUGEINT * fy.f) AS BIGINT) AS score
    FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x AND fx.k = c
    JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y AND fy.k = cuts.k - c),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, c) = 1),
inside AS (SELECT lang, part AS phrase, max(a) AS longer
           FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM candidates WHERE k = 3)
           GROUP BY ALL),
ranked AS (
    SELECT lowest.lang, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, a DESC, lowest.phrase) AS rank, lowest.phrase, a, l, r, score
    FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND inside.phrase = lowest.phrase AND k = 2
    WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@registered
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL["op12_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents),
terms AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM terms GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total
           FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
    SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (total::HUGEINT + 2 * v) AS p
    FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang)
    LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (
    SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n)::HUGEINT + 2)) // (any_value(total)::HUGEINT + 2 * any_value(v)) AS q
    FROM counts JOIN (SELECT lang, sum(total) AS total FROM groups GROUP BY lang) USING (lang) JOIN sizes USING (lang)
    GROUP BY lang, term),
pairs AS (
    SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
all_pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
all_terms AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value
    FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
      FROM (FROM all_pairs UNION ALL FROM all_terms))
WHERE part = 'pair' OR rank <= 10
"""


@registered
def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_edited(_table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id") % 20 == 0)
