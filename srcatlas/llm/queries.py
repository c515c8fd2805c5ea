"""Registered queries of the numbered operators, over whole tables and whole texts with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, lm_score
from .alignment import align
from .common import table
from .decontam import contained
from .exact_dedup import SMALL, UPPER, exact_groups
from .html_text import extract
from .line_dedup import dedup_lines
from .packing import pack
from .simhash import near_groups
from .substring_dedup import dedup_substrings
from .token_store import Store, write_store
from .toxicity import learnable, scored, train
from .vector_dedup import near_vectors


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored(docs.select("doc_id", "text"), model, threshold=0.7).select("doc_id", held_out, "score", "predicted")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # No other column of the table, whatever its name, takes part.
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars"), removed="n_removed_lines")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=4, distance=4)


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Store(spark, write_store(table(spark, sf_dir, "documents"), end_id=0)).digests()


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), length=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and test item that it contains."""
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), words=5, least=0.8)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = table(spark, sf_dir, "conversations")
    return conversations.repaired_conversations(table_, conversations.damaged(table_))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), digests=True)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


ALL = (
    op1_toxicity, op2_line_dedup, op3_simhash, op4_token_store, op5_exact_dedup, op6_html_text, op7_substring_dedup, op8_packing, op9_decontamination, op10_lm_score,
    op11_conversation_repair, op12_alignment, op13_vector_dedup,
)
QUERIES = {f.__name__: f for f in ALL}

#: Distinct shingles of five words of a table's texts, a shorter text being one; words as in decontam.py.
SHINGLES = """SELECT DISTINCT {id} AS id, s FROM (SELECT {id}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(text, '{upper}', '{small}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table} WHERE text IS NOT NULL))"""

ORACLE_SQL = {
    "op9_decontamination": f"""
        WITH d AS ({SHINGLES.format(id="doc_id", table="documents", upper=UPPER, small=SMALL)}),
        i AS ({SHINGLES.format(id="item_id", table="benchmark", upper=UPPER, small=SMALL)}),
        n AS (SELECT id, count(*) AS n FROM i GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_shingles, count(*) AS n_found, count(*) / n.n AS containment
        FROM d JOIN i USING (s) JOIN n ON n.id = i.id GROUP BY d.id, i.id, n.n HAVING count(*) >= 0.8 * n.n""",
    "op5_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{SMALL}') AS norm FROM documents)
        WINDOW g AS (PARTITION BY norm)""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
