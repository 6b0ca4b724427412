"""Reviews, truth and scores as views over the given tables.

The text is the same for Spark and DuckDB.  Every document is one review and every text is whole;
phrases that the rules look for are added to it, by document number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import spread

# A zero-width space, and a ligature that compatibility composition spells out.
HIDDEN, LIGATURE = "​", "ﬁ"

REVIEWS = f"""
SELECT CAST(d.doc_id AS STRING) AS review_id,
       d.source AS business_id,
       'Shop ' || d.source AS biz_name,
       CASE b.item_id % 4 WHEN 0 THEN 'Restaurant, Italian' WHEN 1 THEN 'Spa, Wellness'
                          WHEN 2 THEN 'Electronics, Computers' ELSE 'Park, Outdoor' END AS biz_cats,
       b.text AS biz_desc,
       CASE WHEN d.doc_id % 11 = 0 THEN 'Visit www.example.com now. ' || d.text
            WHEN d.doc_id % 11 = 1 THEN d.text || ' call now for 50% off'
            WHEN d.doc_id % 11 = 2 THEN 'I haven''t been here but ' || d.text
            WHEN d.doc_id % 11 = 3 THEN 'My iPhone and GPU. ' || d.text
            WHEN d.doc_id % 11 = 4 THEN 'Ring +65 9123-4567! ' || d.text
            WHEN d.doc_id % 11 = 5 THEN 'Facial and RTX deals, discounts!! ' || d.text
            WHEN d.doc_id % 11 = 6
                 THEN 'Pro{HIDDEN}mo  at shop [dot] com in the of{LIGATURE}ce ' || d.text
            WHEN d.doc_id % 11 = 7 THEN b.text || ' ' || b.text || ' ' || d.text
            WHEN d.doc_id % 11 = 8 THEN b.text || ' ' || d.text
            WHEN d.doc_id % 11 = 9 THEN chr(9) || ' Mail me@shop.example.org?! 🎉🎉 ' || d.text
            ELSE d.text END AS review_text,
       CASE WHEN d.doc_id % 17 = 0 THEN NULL ELSE CAST(d.doc_id % 6 AS INT) END AS stars,
       CASE WHEN d.doc_id % 19 = 0 THEN NULL
            ELSE CAST(1700000000000 + d.doc_id * 25200000 AS BIGINT) END AS time_ms,
       CASE d.doc_id % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'NY' ELSE 'TX' END AS state,
       'City ' || d.lang AS city,
       CAST(d.doc_id % 90 AS FLOAT) AS lat,
       CAST(0 - d.doc_id % 180 AS FLOAT) AS lon,
       CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE '$$' END AS price,
       d.lang AS lang
FROM documents d LEFT JOIN benchmark b ON b.item_id = CAST(substr(d.source, 4) AS INT)
"""

TRUTH = """
SELECT review_id, label_ads, label_irrelevant, label_rant_no_visit,
       CASE WHEN odd = 1 THEN label_irrelevant ELSE 1 - label_irrelevant END AS label_relevant
FROM (
  SELECT CAST(doc_id AS STRING) AS review_id,
         CASE WHEN (doc_id % 11 IN (0, 1, 4)) <> (doc_id % 13 = 0) THEN 1 ELSE 0 END AS label_ads,
         CASE WHEN (doc_id % 11 NOT IN (7, 8)) <> (doc_id % 7 = 0) THEN 1 ELSE 0 END
           AS label_irrelevant,
         CASE WHEN (doc_id % 11 = 2) <> (doc_id % 29 = 0) THEN 1 ELSE 0 END AS label_rant_no_visit,
         CASE WHEN doc_id % 23 = 0 THEN 1 ELSE 0 END AS odd
  FROM documents)
"""

# Multiples of 1/100, so that scores often equal a threshold exactly.
SCORES = """
SELECT CAST(doc_id AS STRING) AS review_id,
       CAST((doc_id * 37) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS ads_p,
       CAST((doc_id * 53) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS irrelevant_p,
       CAST((doc_id * 71) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS rant_no_visit_p
FROM documents
"""

TABLES = ("documents", "benchmark", "labels")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: table(spark, sf_dir, t) for t in TABLES if t in sql}
    tables["documents"] = spread(tables["documents"])
    for name in tables:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}").replace(
            f"JOIN {name}", f"JOIN {{{name}}}"
        )
    return spark.sql(sql, **tables)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, REVIEWS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, TRUTH)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SCORES)
