"""The operators of this package as queries over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import context_tree, decontaminate, embeddings, hard_negatives, language_id, licences, line_dedup, packing, periodic_runs, pieces, quality, simhash, toxicity
from cairn.llm.common import fold, staged

#: What the documents are packed for.
VOCABULARY = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096
#: What the documents are encoded with and decoded again.
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = language_id.identify(docs, language_id.language_model(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_chars=10, with_text=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = staged(quality.document_statistics(table(spark, sf_dir, "documents")), "statistics")
    held_out = fold("doc_id", 5) == 0
    model = quality.quality_model(stats, table(spark, sf_dir, "labels"), ~held_out)
    return quality.quality_scores(stats, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.code_lengths(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.figures(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.toxicity_scores(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path(), SEQUENCE_TOKENS)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.license_scan(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.figures(periodic_runs.periodic_runs(periodic_runs.planted(table(spark, sf_dir, "documents")), least=6, exponent=4))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), vocabulary_path(PIECES), with_text=False)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_language_id, op2_line_dedup, op3_quality, op4_context_tree, op5_decontamination, op6_simhash, op7_toxicity, op8_best_fit_packing, op9_license_scan, op10_embedding_dedup, op11_periodic_runs, op12_hard_negatives, op13_sentencepiece, pipeline]
    return {f.__name__: f for f in ops}


#: The stripping of [\x20\x09-\x0D] and the lower-casing of A-Z only.
_KEY = "translate(trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP_SQL = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
keyed AS (SELECT doc_id, k, line, {_KEY.format('line')} AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE doc_id > first) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE first IS NULL OR doc_id = first), '')) AS kept_sha256
FROM keyed LEFT JOIN firsts USING (key) GROUP BY doc_id"""

_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

DECONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, {_WORDS.format('text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS win FROM
  (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
spots AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM
  (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, k, s.n, item_id FROM spots s JOIN windows v ON s.win = v.win AND s.n = v.n),
hit_words AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM (SELECT doc_id, k, unnest(generate_series(0, n - 1)) AS j FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) n USING (vec_id)"""


HARD_NEGATIVES_SQL = """
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
positives AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op5_decontamination": DECONTAMINATION_SQL, "op9_license_scan": licences.oracle_sql(), "op10_embedding_dedup": EMBEDDING_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
