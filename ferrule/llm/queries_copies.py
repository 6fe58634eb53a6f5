"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm.nearcopies import pairs_of_rows, similar_classes
from ferrule.sources.tables import table


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs, members = similar_classes(table(spark, folder, "chunks"), "chunk_id", "text", similarity=0.6, words=3)
    return pairs_of_rows(pairs, members, "chunk_id")


def p4_links(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each chunk with its class and the number of other classes its text is linked to."""
    pairs, members = similar_classes(table(spark, folder, "chunks"), "chunk_id", "text")
    ends = pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return members.join(ends, "rep", "left").select(F.col("key").alias("chunk_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {f.__name__: f for f in (p4_found, p4_links)}
ORACLE = {
    "p4_links": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM chunks WHERE text IS NOT NULL),
      k AS (SELECT chunk_id, CASE WHEN len(l) < 5 THEN [array_to_string(l, ' ')]
        ELSE list_sort(list_distinct(list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i:i + 4], ' ')))) END AS g, len(l) >= 5 AS long FROM w),
      c AS (SELECT chunk_id, g, long, min(chunk_id) OVER (PARTITION BY g, long) AS class_id FROM k),
      s AS (SELECT class_id, unnest(g) AS x, len(g) AS n FROM c WHERE long AND chunk_id = class_id),
      p AS (SELECT a.class_id FROM s a JOIN s b ON a.x = b.x AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
      d AS (SELECT class_id, count(*) AS links FROM p GROUP BY 1)
      SELECT c.chunk_id, c.class_id, coalesce(d.links, 0) AS links FROM c LEFT JOIN d ON d.class_id = c.class_id""",
    "p4_found": r"""WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS l FROM chunks),
      s AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2])) AS g FROM w WHERE len(l) >= 3),
      n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
      SELECT x AS chunk_id_a, y AS chunk_id_b FROM p JOIN n a ON a.chunk_id = x JOIN n b ON b.chunk_id = y WHERE c >= 0.6 * (a.n + b.n - c)""",
}
