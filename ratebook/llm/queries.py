"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ratebook.llm import (
    alignment, decontamination, embedding_join, hard_negatives, html_text, language_id, line_dedup, packing, secret_scan, simhash, substring_dedup,
    token_files, warc,
)
from ratebook.llm.common import table

BYTE_VOCABULARY, BYTE_END = "byte_bpe_50k.json", 0
WORD_VOCABULARY, WORD_END = "word_bpe_49k.json", 1
PIECE_MODEL = "piece_bpe_32k.model"


def op1_html_text(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


def op2_secret_scan(spark, folder):
    return secret_scan.scan(table(spark, folder, "documents"))


def op3_token_files(spark, folder):
    path = token_files.write_token_files(table(spark, folder, "documents"), BYTE_VOCABULARY, BYTE_END)
    return token_files.read_token_files(spark, path)


def op4_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"), simhash.EXACT)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_line_dedup(spark, folder):
    found = line_dedup.remove_boilerplate(table(spark, folder, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op6_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = language_id.is_held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), WORD_VOCABULARY, WORD_END)


def op8_embedding_join(spark, folder):
    return embedding_join.near_duplicates(table(spark, folder, "embeddings"))


def op9_warc(spark, folder):
    captures = warc.read_archives(spark, warc.write_archives(table(spark, folder, "pages")))
    return warc.histories(captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")


def op10_decontamination(spark, folder):
    found = decontamination.search(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return decontamination.report(found)


def op11_alignment(spark, folder):
    return alignment.align(table(spark, folder, "documents"), BYTE_VOCABULARY, PIECE_MODEL)


def op12_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_substring_dedup(spark, folder):
    found = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries():
    import corpus_pipeline

    own = {name: f for name, f in globals().items() if name.startswith("op")}
    return own | {"pipeline": corpus_pipeline.run}


#: Lines of five words or more on five sites or more go from all documents but the first that has them.
_OP5_SQL = """
WITH l AS (
  SELECT *, lower(trim(line)) AS norm
  FROM (SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)),
b AS (
  SELECT norm, min(doc_id) AS first_doc FROM l
  WHERE length(norm) - length(replace(norm, ' ', '')) >= 4
  GROUP BY norm HAVING count(DISTINCT site) >= 5),
k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept
  FROM (SELECT l.*, b.norm IS NOT NULL AND l.doc_id IS DISTINCT FROM b.first_doc
          AND length(l.norm) - length(replace(l.norm, ' ', '')) >= 4 AS gone
        FROM l LEFT JOIN b ON l.norm = b.norm)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN length(kept) END AS n_chars_kept,
  CASE WHEN d.text IS NOT NULL THEN md5(kept) END AS text_md5
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""


#: Scores are sums of integers far below 2^53, so doubles hold them exactly.
_OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike,
    CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""


def oracle_sql():
    return {"op5_line_dedup": _OP5_SQL, "op12_hard_negatives": _OP12_SQL}
