"""The operators of this subpackage bound to the shared tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import alignment, decontamination, huffman, language, mixing, packing, privacy, quality, ranking, simhash, suffixes, tokens, urls, vectors
from tallywright.workspace import settle, shared_dir

VOCABULARY, END_ID = "word_bpe_49k.json", 1
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_quality(docs).drop("text", "broken")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
SQL["op6_quality_rules"] = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
grams AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram
  FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM base)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT r, i, unnest(range(0, 8)) AS k FROM twice) GROUP BY r),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(list_filter(words, lambda w: lower(w) IN ({STOPS}))) AS BIGINT) AS n_stop_words
  FROM base LEFT JOIN covered USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND {quality.rule_sql(quality.RULES)} AS kept
FROM counts"""


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def ids_of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return settle(tokens.tokenise(docs, public_tokenizers.path(VOCABULARY), END_ID), "token-ids")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(ids_of_documents(spark, table(spark, sf_dir, "documents")))


@query
def op8_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "id-files")
    huffman.write_ids(ids_of_documents(spark, table(spark, sf_dir, "documents")), folder)
    return huffman.read_ids(spark, folder)


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(spark, sf_dir, "documents"))


@query
def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url", "score")


def url_sql() -> str:
    def level(k: int) -> str:
        ctx = f"substr(s, 1, {k - 1})" if k > 1 else "''"
        p = "CASE WHEN n{0} > 0 THEN ({0} + d{0} * q{0}) / (n{0} + d{0}) ELSE q{0} END AS p{0}"
        shorter = (
            f"JOIN (SELECT s AS tail, pa AS qa, pr AS qr FROM smooth{k - 1}) q ON q.tail = substr(c.s, 2)"
            if k > 1 else "CROSS JOIN (SELECT 1.0::DOUBLE / (count(DISTINCT right(gram, 1)) + 1) AS qa, qa AS qr FROM counts) q"
        )
        return f"""
counts{k} AS (
  SELECT *, {ctx} AS ctx FROM (SELECT right(gram, {k}) AS s, sum(a)::DOUBLE AS a, sum(r)::DOUBLE AS r FROM counts GROUP BY 1)),
totals{k} AS (
  SELECT ctx, sum(a) AS na, sum(r) AS nr, count(*) FILTER (WHERE a > 0) AS da, count(*) FILTER (WHERE r > 0) AS dr
  FROM counts{k} GROUP BY ctx),
smooth{k} AS (
  SELECT c.s, {p.format("a")}, {p.format("r")} FROM counts{k} c JOIN totals{k} t ON t.ctx = c.ctx {shorter}),"""

    rule = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in urls.by_length(urls.RULES)
    )
    allow = ", ".join(f"'{r.name}'" for r in urls.RULES if r.verdict == "allow")
    return f"""
WITH rest AS (
  SELECT page_id, coalesce(url, '') AS url,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (SELECT *, CASE {rule} END AS rule FROM split),
known AS (
  SELECT DISTINCT url, CASE WHEN rule IN ({allow}) THEN 1 WHEN rule IS NULL THEN 0 ELSE -1 END AS kind,
    substr(md5(url), 1, 1) IN ('0', '1', '2') AS held FROM ruled WHERE url <> ''),
grams AS (
  SELECT url, kind, held, substr(repeat(chr(2), 4) || url, i, 5) AS gram
  FROM (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM known)),
counts AS (
  SELECT gram, count(*) FILTER (WHERE NOT held AND kind = 1) AS a, count(*) FILTER (WHERE NOT held AND kind = -1) AS r
  FROM grams GROUP BY gram),{"".join(level(k) for k in range(1, 6))}
scored AS (
  SELECT url, kind, round(sum(ln(pa) - ln(pr)) / count(*), 6) AS score
  FROM grams JOIN smooth5 ON s = gram WHERE kind = 0 OR held GROUP BY url, kind),
steps AS (
  SELECT CAST(floor(score * 100) AS BIGINT) AS step, count(*) FILTER (WHERE kind = 1) AS a,
    count(*) FILTER (WHERE kind = -1) AS r FROM scored WHERE kind <> 0 GROUP BY 1),
errors AS (
  SELECT step, coalesce(lag(step) OVER (ORDER BY step) + 1, step) AS low, round(coalesce(sum(a) OVER below, 0) / nullif(sum(a) OVER (), 0) + 1
    - coalesce(sum(r) OVER below, 0) / nullif(sum(r) OVER (), 0), 9) AS e
  FROM steps WINDOW below AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
cut AS (
  SELECT coalesce((SELECT (step + low) / 200 FROM errors WHERE e IS NOT NULL ORDER BY e, abs(step), step LIMIT 1), 0) AS cut)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({allow}) THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END AS verdict
FROM ruled LEFT JOIN (SELECT url, score FROM scored WHERE kind = 0) USING (url) CROSS JOIN cut"""


SQL["op3_url_filter"] = url_sql()


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return privacy.find_personal(docs, privacy.fit(docs))


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.align_tokenizers(docs, *map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model")))


@query
def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op12_decontamination"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
    FROM (SELECT item_id, {TERMS} AS w FROM benchmark) WHERE len(w) > 0)),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM grams JOIN windows USING (n, gram)),
words AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT r, i, unnest(range(0, n)) AS k FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN words USING (r) LEFT JOIN found USING (r)"""


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op13_ranked_search"] = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {TERMS} AS w FROM documents),
stats AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM docs),
counts AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM docs) GROUP BY r, t),
terms AS (
  SELECT t, CAST(floor(1000 * ln(CAST(2 * N + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counts, stats GROUP BY t, N),
items AS (SELECT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {TERMS} AS w FROM benchmark)),
sizes AS (SELECT r, doc_id, 100 - 75 + ((75 * CAST(len(w) AS BIGINT) * N) // L) AS m FROM docs, stats),
scores AS (
  SELECT i, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN terms USING (t) JOIN counts USING (t) JOIN sizes USING (r) GROUP BY i, item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10"""
