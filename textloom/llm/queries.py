"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, collocations, embeddups, fingerprints, htmltext, mixing, ngramjoin, packing, quality, secrets, suffixdedup, urlfilter, whitening
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.default_samples(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find(docs, model).drop("text")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), of(3).alias("n_markov"),
        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("secrets")).alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = quality.score(docs, model).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.summary(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_embedding_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddups.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = F.col("copies") * F.col("size")
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings")).drop("deviation_exact")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_url_filter": op6_url_filter,
    "op7_html_text": op7_html_text,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_embedding_dups": op10_embedding_dups,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_whitening": op13_whitening,
}



def _pattern_regex(text: str) -> str:
    """A pattern rule for the oracle, in the dialect that both engines read."""
    start = r"^(?:[^/]*\.)?" if text.startswith("||") else ""
    return "(?s)" + start + "".join({"^": "(?:^|$|[^a-z0-9])", "*": ".*"}.get(c, re.escape(c)) for c in text.removeprefix("||"))


_PATTERNS = ", ".join(f"('{x}', '{_pattern_regex(x)}')" for x in urlfilter.PATTERN_RULES)

ORACLES = {
    "op10_embedding_dups": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), u AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
    AND list_inner_product(a.e, b.e) >= 0.9 * a.n * b.n WHERE a.n > 0 AND b.n > 0
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS b FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
""",
    "op6_url_filter": rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path,
    translate(regexp_extract(rest, '^[^#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS part FROM u
), p AS (SELECT * FROM (VALUES {_PATTERNS}) AS t(text, regex)
), m AS (SELECT page_id, max({{'size': length(p.text), 'text': p.text}}) AS best FROM h JOIN p ON regexp_matches(part, regex) GROUP BY page_id
), r AS (
  SELECT h.page_id, host, path, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule, best.text AS pattern
  FROM h LEFT JOIN m ON m.page_id = h.page_id
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'net/de/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule = 'example.com/en/7' THEN 'allow'
    WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN pattern END AS pattern
FROM r
""",
    "op11_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^ \x09]+') AS w FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) AS r(k)
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), s AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f + y.f))::BIGINT AS score FROM c, range(1, 4) AS t(cut)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
  WHERE cut < c.k
), b AS (SELECT lang, phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), i AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS around FROM c, range(2, 4) AS t(m), range(1, 4) AS u(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL
), o AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o
) JOIN n USING (lang) WHERE rank <= 2000
""",
    "op12_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::HUGEINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w FROM d GROUP BY source
), a AS (SELECT list({'z': source_size, 'w': w}) AS l, sum(source_size)::HUGEINT AS z FROM s
), r AS (
  SELECT 0 AS step, 3 * z AS high, 2 * list_sum(list_transform(l, lambda x: x.w))::HUGEINT AS low FROM a
  UNION ALL
  SELECT step + 1, 3 * z - 4 * list_sum(list_transform(l, lambda x: CASE WHEN 2 * x.z * low < x.w * high THEN x.z ELSE 0 END))::HUGEINT,
    2 * list_sum(list_transform(l, lambda x: CASE WHEN 2 * x.z * low < x.w * high THEN 0 ELSE x.w END))::HUGEINT FROM r, a WHERE step < 30
), e AS (SELECT high, low FROM r ORDER BY step DESC LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size * low < w * high THEN (2 * source_size)::DOUBLE ELSE w::DOUBLE * high::DOUBLE / low::DOUBLE END AS target,
    list_transform(range(16), lambda j: ('0x' || substr(md5('13:' || j || ':' || coalesce('s' || source, 't')), 1, 6))::BIGINT) AS offs FROM s, e
), c AS (
  SELECT doc_id, d.source, size, source_size, target, offs, least(CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE * 16777216 + 0.5)::BIGINT ELSE 0 END, 33554432) AS p,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), j AS (SELECT source, j, any_value(offs[j + 1]) AS off, abs(sum(((k * p + offs[j + 1]) // 16777216 - ((k - 1) * p + offs[j + 1]) // 16777216) * size) - any_value(target)) AS miss FROM c, range(16) AS x(j) GROUP BY source, j
), o AS (SELECT source, arg_min(off, {'miss': miss, 'j': j}) AS off FROM j GROUP BY source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (((k * p + off) // 16777216 - ((k - 1) * p + off) // 16777216) * size)::BIGINT AS taken FROM c JOIN o ON c.source IS NOT DISTINCT FROM o.source
""",
}
