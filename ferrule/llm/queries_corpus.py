"""Queries of problems 2, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import fusion, packing, quantiles, splitting, tokens
from ferrule.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    flows = fusion.ranking(table(spark, folder, "shortlist"), table(spark, folder, "candidate_scores"))
    return fusion.first_places(flows, table(spark, folder, "chunks"))


def p2_ranking(spark: SparkSession, folder: str) -> DataFrame:
    flows = fusion.ranking(table(spark, folder, "shortlist"), table(spark, folder, "candidate_scores"))
    return flows.select("qid", "path", "start_line", "end_line", F.round("flow", 9).alias("flow"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantiles.wrong_p95(table(spark, folder, "summary"), table(spark, folder, "records"))


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches of single days, merged to one for each client."""
    days = quantiles.merge_sketches(quantiles.sketch(quantiles.records_once(table(spark, folder, "records")), ["client_name", "day"], "wall"), ["client_name", "day"])
    merged = quantiles.merge_sketches(days.select("client_name", "sketch"), ["client_name"], salts=8)
    return quantiles.percentiles(merged, ["client_name"], {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def p6_check(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each percentile of `p6_percentiles` stands where it should among all values of its client: its rank is
    off by at most 2 % of the values above it, five standard errors, and one."""
    ranks = {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    found = p6_percentiles(spark, folder)  # one row a client
    values = quantiles.records_once(table(spark, folder, "records")).where("wall IS NOT NULL").select(F.col("client_name").alias("c"), F.col("wall").cast("double").alias("v"))
    below = [F.count_if(F.col("v") < F.col(r)).alias(f"{r}_lt") for r in ranks] + [F.count_if(F.col("v") <= F.col(r)).alias(f"{r}_le") for r in ranks]
    g = values.join(F.broadcast(found.drop("n")), F.col("c").eqNullSafe(F.col("client_name"))).groupBy("client_name").agg(F.count(F.lit(1)).alias("n"), *below)
    within = lambda r, q: F.greatest(F.col("n") * q - F.col(f"{r}_le"), F.col(f"{r}_lt") - F.col("n") * q) <= 0.02 * (1 - q) * F.col("n") + 1
    return g.select("client_name", "n", *[within(r, q).alias(r) for r, q in ranks.items()])


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks")).where("piece = 0").select("chunk_id").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(table(spark, folder, "chunks"))


def p7_check(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the pieces of each chunk: none is too large, they cover its lines and join to its text."""
    pieces = splitting.split_oversized(table(spark, folder, "chunks"))
    own = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("shared") + 1, F.octet_length("text")), "UTF-8")
    g = pieces.withColumn("own", own).groupBy("chunk_id").agg(
        F.count_if(F.octet_length("text") > 4000).alias("too_large"), F.min("start_line").alias("first_line"), F.sort_array(F.collect_list(F.struct("piece", "own"))).alias("l")
    )  # the pieces of one text
    return g.select("chunk_id", "too_large", "first_line", F.md5(F.array_join("l.own", "")).alias("joined"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(table(spark, folder, "documents"), ["doc_id"])


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, folder, "documents"), ["doc_id"])
    return packing.pack(sizes, "doc_id", "n_tokens", 2048)


def p9_check(spark: SparkSession, folder: str) -> DataFrame:
    """What holds for the containers: every document is placed whole, in pieces only if it is longer than one."""
    placed = p9_containers(spark, folder)
    full = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("size").alias("filled"))
    docs = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").alias("size"), F.max("piece").alias("last"))
    torn = F.count_if((F.col("pieces") != F.col("last") + 1) | (F.coalesce("size", F.lit(0)) <= 2048) & (F.col("pieces") > 1))
    return docs.agg(F.count(F.lit(1)).alias("documents"), torn.alias("torn")).crossJoin(F.broadcast(full.agg(F.count_if(F.col("filled") > 2048).alias("too_full"))))  # two single rows


QUERIES = {f.__name__: f for f in (p2_found, p2_ranking, p6_found, p6_percentiles, p6_check, p7_found, p7_pieces, p7_check, p8_ids, p9_containers, p9_check)}

_CANDIDATES = """
WITH u AS (
  SELECT qid, path, start_line, end_line, chunk_id, lexical_score, NULL::DOUBLE AS score, NULL::BOOLEAN AS connected FROM shortlist
  UNION ALL
  SELECT qid, path, start_line, end_line, NULL, NULL, score, connected FROM candidate_scores),
c AS (
  SELECT qid, path, start_line, end_line, max(chunk_id) AS chunk_id, coalesce(max(lexical_score), '-inf'::DOUBLE) AS l,
         coalesce(max(score), '-inf'::DOUBLE) AS s, CASE WHEN coalesce(bool_or(connected), false) THEN 1.0 ELSE 0.0 END AS k
  FROM u GROUP BY ALL),
x AS (
  SELECT *, (rank() OVER (PARTITION BY qid ORDER BY l) - 1 + count(*) OVER (PARTITION BY qid, l) / 2) / count(*) OVER (PARTITION BY qid) AS xl,
         (rank() OVER (PARTITION BY qid ORDER BY s) - 1 + count(*) OVER (PARTITION BY qid, s) / 2) / count(*) OVER (PARTITION BY qid) AS xs,
         (rank() OVER (PARTITION BY qid ORDER BY k) - 1 + count(*) OVER (PARTITION BY qid, k) / 2) / count(*) OVER (PARTITION BY qid) AS xk
  FROM c),
flows AS (
  SELECT a.qid, a.path, a.start_line, a.end_line, a.chunk_id,
         sum(greatest(-1, least(1, (a.xl - b.xl) / 0.5)) + greatest(-1, least(1, (a.xs - b.xs) / 0.5))
             + 0.1 * greatest(-1, least(1, (a.xk - b.xk) / 0.5))) / 2.1 / greatest(count(*) - 1, 1) AS flow
  FROM x a JOIN x b ON a.qid = b.qid GROUP BY ALL)
"""
_SUCCEEDED = """
WITH once AS (
  SELECT runId, lower(trim(client.name)) AS client_name, condition.requested AS requested, timing.totalWallNs AS wall, status
  FROM records QUALIFY row_number() OVER (PARTITION BY runId, recordId ORDER BY receivedAt) = 1),
ok AS (SELECT * FROM once WHERE status = 'succeeded' AND wall IS NOT NULL)
"""
ORACLE = {
    "p2_found": _CANDIDATES + """
, best AS (
  SELECT * FROM flows QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(flow, 12) DESC, path, start_line, end_line) = 1)
SELECT b.qid, coalesce(b.chunk_id, c.chunk_id) AS chunk_id
FROM best b LEFT JOIN chunks c ON b.path = c.path AND b.start_line = c.start_line AND b.end_line = c.end_line
""",
    "p2_ranking": _CANDIDATES + "SELECT qid, path, start_line, end_line, round(flow, 9) AS flow FROM flows",
    "p6_found": _SUCCEEDED + """
, p AS (SELECT runId, client_name, requested, quantile_disc(wall, 0.95) AS p95 FROM ok GROUP BY ALL)
SELECT DISTINCT s.runId AS run_id, s.client.name AS client_name, s.condition.requested AS requested
FROM summary s JOIN p ON s.runId = p.runId AND lower(trim(s.client.name)) = p.client_name AND s.condition.requested IS NOT DISTINCT FROM p.requested
WHERE coalesce(abs(s.latencyNs.p95 - p.p95) > 0.05 * p.p95, true)
""",
    "p6_check": _SUCCEEDED + "SELECT client_name, count(*) AS n, true AS median, true AS p90, true AS p95, true AS p99 FROM ok GROUP BY client_name",
    "p7_check": "SELECT chunk_id, 0::BIGINT AS too_large, start_line AS first_line, md5(text) AS joined FROM chunks WHERE strlen(text) > 4000",
    "p9_check": "SELECT count(DISTINCT doc_id) AS documents, 0::BIGINT AS torn, 0::BIGINT AS too_full FROM documents",
    "p7_found": "SELECT chunk_id FROM chunks WHERE strlen(text) > 4000",
}
