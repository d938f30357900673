"""Queries of the training-text problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.leakage import leaked_items
from strandloom.llm.near_duplicates import experience_words, near_duplicate_groups, near_duplicate_pairs
from strandloom.llm.packing import context_windows
from strandloom.llm.subjects import subject_areas, subject_posteriors
from strandloom.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicate_pairs(experience_words(table(spark, sf_dir, "experience")))
    return pairs.select(F.col("id_a").alias("exp_id_a"), F.col("id_b").alias("exp_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per experience with its class of copies, its group and the number of its links."""
    return near_duplicate_groups(experience_words(table(spark, sf_dir, "experience"))).withColumnRenamed("id", "exp_id")


def p6_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the windows of each context budget."""
    return context_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "context_budgets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_by_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents leak each evaluation item."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    hits = p7_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.join(hits, "item_id", "left").select("item_id", "suite", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subject_areas(*(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


def p8_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share and posterior of each subject of each document."""
    return subject_posteriors(*(table(spark, sf_dir, t) for t in ("documents", "subjects", "subject_labels")))


QUERIES = {f.__name__: f for f in (p4_found, p4_groups, p6_windows, p7_found, p7_by_item, p8_found, p8_posteriors)}

_EXPERIENCE_WORDS = """
  told AS (SELECT DISTINCT exp_id, list_sort(list_distinct(regexp_extract_all(lower(concat_ws(' ', last_error,
        array_to_string(list_transform(coalesce(memory_records, []), lambda r: concat_ws(' ', r.error_signature, r.root_cause)), ' '))), '[a-z0-9]+'))) AS w
      FROM experience WHERE exp_id IS NOT NULL),
  recs AS (SELECT exp_id, w FROM told WHERE len(w) >= 10)"""

SQL = {
    "p4_found": f"""WITH {_EXPERIENCE_WORDS}
SELECT DISTINCT a.exp_id AS exp_id_a, b.exp_id AS exp_id_b FROM recs a JOIN recs b ON a.exp_id < b.exp_id
WHERE len(list_intersect(a.w, b.w)) * 100 >= 65 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))""",
    "p7_found": """WITH
  items AS (SELECT item_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM eval_items),
  docs AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents),
  passages AS (SELECT item_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM items)),
  runs AS (SELECT doc_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM docs))
SELECT DISTINCT doc_id, item_id FROM runs JOIN passages USING (g)""",
}
SQL["p7_by_item"] = f"""SELECT item_id, suite, count(doc_id) AS n_documents
FROM (SELECT DISTINCT item_id, suite FROM eval_items) LEFT JOIN ({SQL["p7_found"]}) USING (item_id) GROUP BY item_id, suite"""
