"""The registered queries of this package and their DuckDB SQL (where SQL can express them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, collocations, decontaminate, lexical, line_dedup, lm_score, packing, quality, quotes, simhash,
               token_files, topk, toxicity)
from .common import crc_remainder, read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP_SQL = f"""
WITH l AS (
  SELECT doc_id, u.pos AS pos, u.line AS line, translate(trim(u.line, {_WS}), {_AZ}) AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
       LATERAL (SELECT unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos) u
), s AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.doc_id, l.pos, l.line, (s.key IS NOT NULL AND l.doc_id <> s.keeper) AS gone
  FROM l LEFT JOIN s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query("op3_line_dedup", LINE_DEDUP_SQL)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    clean = line_dedup.dedup_lines(docs)
    return clean.select("doc_id", "n_lines", "n_dropped",
                        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"), drop_text=True)
    ids = F.array_join(F.array_sort("hit_items"), ",")
    return marked.select("doc_id", "n_words", decontaminate.n_hit().alias("n_hit"),
                         F.size("hit_items").cast("bigint").alias("n_items"),
                         F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
                         decontaminate.contaminated().alias("contaminated"))


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.group_near(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = quality.training_labels(read_table(spark, sf_dir, "labels"), "quality", 4, 2)
    scored = quality.score_documents(docs, labels)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
                         quality.predicted(F.col("score")).alias("predicted"))


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"), ids=False, digests=True, drop_text=True)


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op8_exact_top_k", TOP_K_SQL)
def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.pmod(F.col("id"), F.lit(50)) == 0, k=5)


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = quality.training_labels(read_table(spark, sf_dir, "labels"), "toxic", 5, 0)
    scored = toxicity.score_toxicity(docs, labels)
    return scored.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         toxicity.predicted(F.col("score")).alias("predicted"), "n_matches")


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.index_documents(docs, tokenizer_path("byte_bpe_50k.json"))


#: What the links must be, from the conversations themselves: a turn answers the one before it.
QUOTES_SQL = """
WITH m AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
         lag(turn) OVER w = turn - 1 AND length(trim(lag(text) OVER w)) > 0 AS answers
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), t AS (
  SELECT *, sum(CASE WHEN answers THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS thread FROM m
)
SELECT conv_id, turn, role, CASE WHEN answers THEN turn - 1 END AS parent_turn,
       min(turn) OVER (PARTITION BY conv_id, thread) AS root_turn,
       row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) - 1 AS depth,
       row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn) AS position,
       CAST(0 AS BIGINT) AS n_unlinked, sha256(text) AS clean_sha256
FROM t
"""


@query("op1_quote_links", QUOTES_SQL)
def op1_quote_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_quotes(quotes.as_mail(read_table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "role", "parent_turn", "root_turn", "depth", "position", "n_unlinked",
                         F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


LEXICAL_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(text, {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ts
  FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d WHERE len(ts) > 0
), i AS (
  SELECT row_number() OVER () AS iid, item_id,
         unnest(regexp_extract_all(translate(text, {_AZ}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
), q AS (
  SELECT iid, item_id, term, count(*) AS times FROM i GROUP BY ALL
), t AS (
  SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0 * max(big_n) + 2)::DOUBLE / (2.0 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM t, g GROUP BY term
), m AS (
  SELECT rid, doc_id, 25 + (75 * len(ts) * big_n) // big_l AS m FROM d, g WHERE len(ts) > 0
), s AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY ALL
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op11_ranked_search", LEXICAL_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    packed = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


COLLOCATIONS_SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS ws FROM p
), total AS (
  SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM s GROUP BY lang
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i
        FROM s, (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), sub AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN sub USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT kept.lang, kept.phrase, kept.a, n, cut, l.a AS l, r.a AS r,
         CAST((1000::HUGEINT * kept.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept) kept
  JOIN total USING (lang)
  JOIN f l ON l.lang = kept.lang AND l.phrase = array_to_string(kept.ws[1:cut], ' ')
  JOIN f r ON r.lang = kept.lang AND r.phrase = array_to_string(kept.ws[cut + 1:kept.k], ' ')
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs, top=2000, min_count=100)
