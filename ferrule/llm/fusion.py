"""One order from several scores of different scale: outranking net flow on percentiles.

Within a question each score becomes a percentile. A candidate is preferred to another on a score by how
far its percentile lies above, nothing up to `indifference`, fully from `strict` on. The flow of a candidate
is the weighted mean of its preferences over all others minus theirs over it. The sums over all others are
exact and need no pairs: they are prefix sums over the sorted percentiles, read at four places.

Questions may be of any size. Equal values are one row with a count; a question's values are cut into
tiles, sums run within tiles, and the few tile totals of a question run on top.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.session import materialize

TILES = 4096


def _running(rows: DataFrame, order: str, sums: dict[str, str], tile: Column) -> DataFrame:
    """`rows` (with __g) and the sums of all rows of the group that come before in `order`."""
    rows = rows.withColumn("__t", tile)
    totals = rows.groupBy("__g", "__t").agg(*[F.sum(c).alias(f"__b_{n}") for n, c in sums.items()])
    above = Window.partitionBy("__g").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)  # at most some thousand tiles
    totals = totals.select("__g", "__t", *[F.coalesce(F.sum(f"__b_{n}").over(above), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__g", "__t").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    rows = rows.join(totals, ["__g", "__t"])
    return rows.select(*[c for c in rows.columns if c not in sums and not c.startswith("__b_") and c != "__t"], *[(F.col(n) + F.col(f"__b_{n}")).alias(n) for n in sums])


def percentile_rows(values: DataFrame) -> DataFrame:
    """__g, __v, __c (count of equal values) and __x, the middle percentile of those values, in (0, 1)."""
    rows = values.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c"))
    # Even in the logarithm, so a long tail spreads over the tiles; monotone, which is all that matters.
    tile = F.when(F.col("__v") == float("-inf"), F.lit(-TILES)).otherwise(F.floor(F.signum("__v") * F.log1p(F.abs("__v") * 1e6) * 64))
    rows = _running(rows, "__v", {"__less": "__c"}, tile.cast("long"))
    size = values.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    return rows.join(size, "__g").select("__g", "__v", "__c", "__n", ((F.col("__less") + F.col("__c") / 2) / F.col("__n")).alias("__x"))


def flow_rows(ranked: DataFrame, indifference: float, strict: float) -> DataFrame:
    """__g, __v and __f: mean preference over the others minus the others' over it, in [-1, 1]."""
    # Four places are read for each value: how much weight lies below x - strict, x - indifference, and the mirror.
    reads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate((-strict, -indifference, indifference, strict))])
    asked = ranked.select("__g", "__v", F.explode(reads).alias("r"), "__x").select("__g", "__v", F.col("r.i").alias("__i"), (F.col("__x") + F.col("r.d")).alias("__at"), F.lit(0).cast("long").alias("__c"), F.lit(0.0).alias("__cx"))
    own = ranked.select("__g", "__v", F.lit(-1).alias("__i"), F.col("__x").alias("__at"), "__c", (F.col("__c") * F.col("__x")).alias("__cx"))
    tile = F.floor(F.greatest(F.lit(-0.01), F.least(F.lit(1.01), F.col("__at"))) * TILES).cast("long")
    run = _running(own.unionByName(asked), "__at", {"__k": "__c", "__s": "__cx"}, tile).where("__i >= 0")
    pick = lambda i, c: F.max(F.when(F.col("__i") == i, F.col(c)))
    wide = run.groupBy("__g", "__v").agg(*[pick(i, c).alias(f"{c}{i}") for i in range(4) for c in ("__k", "__s")])
    r = wide.join(ranked.select("__g", "__v", "__x", "__n"), ["__g", "__v"]).join(ranked.groupBy("__g").agg(F.sum(F.col("__c") * F.col("__x")).alias("__all")), "__g")
    x, n, width = F.col("__x"), F.col("__n"), strict - indifference
    k = [F.col(f"__k{i}") for i in range(4)]
    s = [F.col(f"__s{i}") for i in range(4)]
    over = k[0] + ((k[1] - k[0]) * (x - indifference) - (s[1] - s[0])) / width
    under = (n - k[3]) + ((s[3] - s[2]) - (k[3] - k[2]) * (x + indifference)) / width
    return r.select("__g", "__v", ((over - under) / F.greatest(n - 1, F.lit(1))).alias("__f"))


def net_flow(items: DataFrame, group: str, keys: list[str], weights: dict[str, float], indifference: float = 0.0, strict: float = 0.5, out: str = "flow") -> DataFrame:
    """The group and key columns and `out` DOUBLE in [-1, 1], higher is better.

    weights: {score column: weight}, summing to any positive number. A null or NaN score is the lowest of
    its group; true is above false. Equal scores get equal flows; repeated rows count as often as they
    occur. A group of one row has flow 0. A null group is a group of its own. An empty table gives an empty
    result; other columns are ignored.
    """
    total = float(sum(weights.values()))
    names = list(weights)
    score = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(float("-inf"))) + F.lit(0.0)
    rows = items.select(F.col(group).alias("__group"), *[F.col(k).alias(f"__key_{k}") for k in keys], F.array(*[F.struct(F.lit(i).alias("i"), score(c).alias("v")) for i, c in enumerate(names)]).alias("__scores"))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "scores")  # ids are fixed from here on
    # All scores go through one plan: (group, score) is the unit whose values are ranked.
    long = rows.select("__row", F.col("__group"), F.explode("__scores").alias("s")).select("__row", F.struct("__group", "s.i").alias("__g"), F.col("s.v").alias("__v"))
    ranked = materialize(percentile_rows(long.select("__g", "__v")), "percentiles")
    weight = F.element_at(F.array(*[F.lit(w / total) for w in weights.values()]), F.col("__g.i") + 1)
    flows = long.join(flow_rows(ranked, indifference, strict), ["__g", "__v"]).groupBy("__row").agg(F.sum(F.col("__f") * weight).alias(out))
    return rows.join(flows, "__row").select(F.col("__group").alias(group), *[F.col(f"__key_{k}").alias(k) for k in keys], out)


def candidates(shortlist: DataFrame, judged: DataFrame) -> DataFrame:
    """Each candidate of a question once: qid, path, start_line, end_line, chunk_id (null where only linked),
    lexical_score, score, connected. Of repeated rows the highest scores stay."""
    place = ["qid", "path", "start_line", "end_line"]
    null = lambda t: F.lit(None).cast(t)
    a = shortlist.select(*place, "chunk_id", "lexical_score", null("double").alias("score"), null("boolean").alias("connected"))
    b = judged.select(*place, null("long").alias("chunk_id"), null("double").alias("lexical_score"), "score", "connected")
    return a.unionByName(b).groupBy(*place).agg(F.max("chunk_id").alias("chunk_id"), F.max("lexical_score").alias("lexical_score"), F.max("score").alias("score"), F.coalesce(F.max("connected"), F.lit(False)).alias("connected"))


#: lexical_score and score weigh the same; a link alone only tips near-equal candidates.
WEIGHTS = {"lexical_score": 1.0, "score": 1.0, "connected": 0.1}


def ranking(shortlist: DataFrame, judged: DataFrame) -> DataFrame:
    """All candidates of all questions with their flow and rank: qid, path, start_line, end_line, chunk_id, flow."""
    return net_flow(candidates(shortlist, judged), "qid", ["path", "start_line", "end_line", "chunk_id"], WEIGHTS)


def first_places(flows: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id of each question's best candidate; ties go to the smaller path and line."""
    best = flows.groupBy("qid").agg(F.min_by(F.struct("path", "start_line", "end_line", "chunk_id"), F.struct(-F.round("flow", 12), F.col("path"), F.col("start_line"), F.col("end_line"))).alias("b")).select("qid", "b.*")
    known = best.where("chunk_id IS NOT NULL").select("qid", "chunk_id")
    # Linked candidates have no chunk_id of their own; the place leads to it.
    linked = best.where("chunk_id IS NULL").drop("chunk_id").join(chunks.select("path", "start_line", "end_line", "chunk_id"), ["path", "start_line", "end_line"])
    return known.unionByName(linked.select("qid", "chunk_id"))
