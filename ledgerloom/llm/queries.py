"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.consensus import krippendorff, label_consensus, label_votes
from ledgerloom.llm.grouping import coordinated_pairs, group_pairs
from ledgerloom.llm.neighbours import nearest_neighbours, neighbour_pairs
from ledgerloom.llm.leaks import find_leaks
from ledgerloom.llm.stuffing import stuffed_pages
from ledgerloom.llm.tokens import encode_corpus
from ledgerloom.sources.tables import spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "wallet_embeddings")
    return neighbour_pairs(nearest_neighbours(vectors, "wallet_address", "vector", recency="created_at"))


def p1_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with factor one, which SQL can check; ``p1_found`` may miss a few pairs."""
    near = nearest_neighbours(table(spark, sf_dir, "wallet_embeddings"), "wallet_address", "vector", recency="created_at", relax=1.0)
    return near.withColumnRenamed("id", "wallet_address")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_consensus(table(spark, sf_dir, "labels")).items.select("label_domain", "object_id", "consensus_label")


def p2_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_consensus(table(spark, sf_dir, "labels"), least_reviewers=2).items


def p2_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_consensus(table(spark, sf_dir, "labels")).reviewers


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return krippendorff(label_votes(table(spark, sf_dir, "labels")), "label_domain", "object_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = coordinated_pairs(table(spark, sf_dir, "wallet_similarities"), "wallet1", "wallet2", "is_coordinated", "computed_at", "id")
    return group_pairs(pairs).withColumnRenamed("member", "wallet")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_exact": p1_exact, "p2_found": p2_found, "p2_items": p2_items, "p2_reviewers": p2_reviewers, "p2_agreement": p2_agreement,
    "p4_found": p4_found, "p7_ids": p7_ids, "p8_found": p8_found, "p9_found": p9_found,
}

_TOP5 = """
    usable AS (
      SELECT wallet_address, vector::DOUBLE[] AS v FROM wallet_embeddings
      WHERE wallet_address IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
      QUALIFY row_number() OVER (PARTITION BY wallet_address ORDER BY created_at DESC, vector DESC) = 1),
    near AS (
      SELECT a.wallet_address AS id, b.wallet_address AS neighbour, round(list_cosine_similarity(a.v, b.v), 9) AS similarity
      FROM usable a JOIN usable b ON a.wallet_address <> b.wallet_address
      QUALIFY row_number() OVER (PARTITION BY a.wallet_address ORDER BY round(list_cosine_similarity(a.v, b.v), 9) DESC, b.wallet_address) <= 5)"""

_JUDGED = r"""
    sides AS (
      SELECT label_domain, object_id, reviewer_id AS r, human_label AS l, reviewed_at AS t, updated_at AS u FROM labels
      UNION ALL SELECT label_domain, object_id, second_reviewer_id, second_label, second_reviewed_at, updated_at FROM labels),
    spelled AS (
      SELECT label_domain, object_id, t, u, trim(regexp_replace(lower(r), '[\s\p{Z}_-]+', '_', 'g'), '_') AS reviewer,
             trim(regexp_replace(lower(l), '[\s\p{Z}_-]+', '_', 'g'), '_') AS label FROM sides),
    votes AS (
      SELECT label_domain, object_id, reviewer, label FROM spelled WHERE reviewer <> '' AND label <> '' AND object_id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY label_domain, object_id, reviewer ORDER BY t DESC NULLS LAST, u DESC NULLS LAST, label DESC) = 1)"""

SQL = {
    "p2_agreement": f"""WITH {_JUDGED},
    cells AS (SELECT label_domain, object_id, label, count(*) AS c FROM votes GROUP BY ALL),
    sizes AS (SELECT label_domain, object_id, sum(c) AS n, sum(c * c) AS sq FROM cells GROUP BY ALL HAVING sum(c) >= 2),
    observed AS (SELECT label_domain, sum((n * n - sq) / (n - 1)) AS apart, sum(n) AS total, count(*) AS objects FROM sizes GROUP BY ALL),
    margins AS (SELECT label_domain, label, sum(c) AS m FROM cells JOIN sizes USING (label_domain, object_id) GROUP BY ALL),
    squares AS (SELECT label_domain, sum(m * m) AS msq FROM margins GROUP BY ALL)
    SELECT label_domain, round(1 - (total - 1) * apart / (total * total - msq), 6) AS alpha, objects FROM observed JOIN squares USING (label_domain)""",
    "p4_found": """WITH RECURSIVE newest AS (
      SELECT least(wallet1, wallet2) AS u, greatest(wallet1, wallet2) AS v, is_coordinated FROM wallet_similarities WHERE wallet1 <> wallet2
      QUALIFY row_number() OVER (PARTITION BY least(wallet1, wallet2), greatest(wallet1, wallet2) ORDER BY computed_at DESC NULLS LAST, id DESC) = 1),
    linked AS (SELECT u, v FROM newest WHERE is_coordinated UNION SELECT v, u FROM newest WHERE is_coordinated),
    reach AS (SELECT DISTINCT u AS wallet, u AS other FROM linked UNION SELECT r.wallet, l.v FROM reach r JOIN linked l ON l.u = r.other)
    SELECT wallet, min(other) AS group_id FROM reach GROUP BY wallet""",
    "p1_exact": f"""WITH {_TOP5} SELECT id AS wallet_address, neighbour, similarity,
    CAST(row_number() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS INT) AS rank FROM near""",
}
