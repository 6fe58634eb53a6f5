"""Queries on named definitions, judged candidates, texts cut to size and evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrule.functions import questions as Q
from ferrule.functions import text as X
from ferrule.operators import calllog, candidates, chunking, evaluation, index, lookup, requests
from ferrule.plans import lexical as L
from ferrule.sources.tables import table

KEY = candidates.KEY


def _defined(spark, folder):
    """Declared names as definitions that span their chunk."""
    c = L._chunks(spark, folder)
    d = index.symbols(c, ["start_line", "end_line"]).select("name", F.col("name").alias("qualified"), "path", "start_line", "end_line").distinct()
    return d.withColumn("exported", ~F.col("name").startswith("_"))


def _wanted(spark, folder):
    """Asked for by a question are the names that its shortlisted chunks declare, as they are and in lower case."""
    names = table(spark, folder, "shortlist").select("qid", "chunk_id").distinct().join(index.symbols(L._chunks(spark, folder)), "chunk_id")
    both = names.select("qid", F.explode(F.array("name", F.lower("name"))).alias("name")).distinct()
    return both.withColumn("order", F.length("name"))


def named_definitions(spark, folder):
    f = lookup.lookup(_wanted(spark, folder), _defined(spark, folder))
    return f.select("qid", "name", "level", "path", "start_line")


def missing_names(spark, folder):
    w = _wanted(spark, folder)
    return lookup.missing(w, lookup.lookup(w, _defined(spark, folder)))


def definition_pins(spark, folder):
    return lookup.pins(lookup.lookup(_wanted(spark, folder), _defined(spark, folder)), table(spark, folder, "questions"))


def pinned_list(spark, folder):
    """The given shortlist behind the pins of its question."""
    return lookup.pinned_shortlist(definition_pins(spark, folder), L._given(spark, folder).withColumnRenamed("rn", "rank"))


def _judged(spark, folder):
    c = candidates.merged(table(spark, folder, "candidate_scores"))
    return c.withColumn("result", F.coalesce((F.col("score") > 0.5) & (F.col("place") <= 5), F.lit(False)))


def merged_candidates(spark, folder):
    return candidates.merged(table(spark, folder, "candidate_scores"))


def runner_ups(spark, folder):
    return candidates.runners_up(_judged(spark, folder)).select(*KEY, "score")


def further_candidates(spark, folder):
    j = _judged(spark, folder)
    return candidates.others(j, j.where("result")).select(*KEY, "place")


def region_per_file(spark, folder):
    return candidates.region_per_file(L._given(spark, folder).withColumnRenamed("rn", "rank")).select(*KEY, "rank", "place")


def joined_lists(spark, folder):
    """The given shortlist and behind it the candidates that came by a link or were judged only."""
    return candidates.joined_lists(L._given(spark, folder).withColumnRenamed("rn", "place"), merged_candidates(spark, folder))


def changed_evidence(spark, folder):
    """Questions whose judged candidates differ from the given shortlist."""
    return candidates.changed_evidence(table(spark, folder, "shortlist"), table(spark, folder, "candidate_scores"))


def chosen_actions(spark, folder):
    """The candidate to look at next, or none where finishing is given one half."""
    c = table(spark, folder, "candidate_scores").where("score IS NOT NULL").select("qid", F.concat_ws(":", "path", "start_line").alias("action"), F.col("score").alias("p"))
    return candidates.chosen_actions(c, table(spark, folder, "questions").select("qid", F.lit(0.5).alias("p")))


def distinct_evidence(spark, folder):
    """Files as actions on their judged chunks, without what the given shortlist has shown."""
    a = table(spark, folder, "candidate_scores").select(*KEY, F.col("path").alias("label"), F.length("path").alias("order")).distinct()
    return candidates.distinct_evidence(a, table(spark, folder, "shortlist")).select("qid", "label", F.size("evidence").alias("chunks"))


def copies_by_name(spark, folder):
    c = L._chunks(spark, folder)
    return candidates.copies(c, index.symbols(c)).select("name", "chunk_a", "chunk_b", F.round("similarity", 9).alias("similarity"))


def distinct_sources(spark, folder):
    """Each text of rank_items once, with the first id and the number of rows that have it."""
    i = table(spark, folder, "rank_items").where("text IS NOT NULL")
    return i.groupBy(F.md5("text").alias("digest")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("items"))


def scope_of_directory(spark, folder):
    """Files of each workspace below its folder src/."""
    c = L._chunks(spark, folder).where(F.startswith("path", F.lit("src/")))
    return c.groupBy("workspace").agg(F.count_distinct("path").alias("files"))


def text_cuts(spark, folder):
    i = table(spark, folder, "rank_items").where("text IS NOT NULL").select("id", "text").distinct()
    return i.select("id", F.md5("text").alias("of"), X.trimmed_row("text").alias("row"), X.byte_prefix("text", 40).alias("bytes40"), X.json_prefix("text", 60).alias("json60"))


def path_languages(spark, folder):
    return L._chunks(spark, folder).groupBy(X.language_of("path").alias("language")).agg(F.count_distinct("path").alias("files"))


def question_expansions(spark, folder):
    q = table(spark, folder, "questions").where("question IS NOT NULL")
    return q.select("qid", F.posexplode(X.expansions("question")).alias("place", "query"))


def question_classes(spark, folder):
    q = table(spark, folder, "questions").where("question IS NOT NULL")
    c = F.col("question")
    none = F.array().cast("array<string>")
    return q.select("qid", Q.asks_for_unused(c).alias("unused"), Q.asks_for_dependents(c).alias("dependents"), Q.asks_for_callers(c).alias("callers"), Q.stands_alone(c).alias("alone"), Q.code_shaped(c).alias("code_shaped"), Q.route(c, F.lit(None).cast("string"), none).alias("route"))


def answer_budgets(spark, folder):
    """Results and bytes of an answer to all questions of a workspace at once."""
    n = table(spark, folder, "questions").groupBy("workspace").agg(F.count(F.lit(1)).alias("questions"))
    return n.select("workspace", "questions", *requests.answer_budget(F.col("questions")))


def id_hits(spark, folder):
    r = L._given(spark, folder).select("qid", F.col("path").alias("item"), F.col("rn").alias("rank"))
    return evaluation.id_hits(r, L._gold(spark, folder).select("qid", F.col("path").alias("item")), table(spark, folder, "questions"))


def mode_summary(spark, folder):
    r = table(spark, folder, "records")
    failed = F.coalesce(F.col("status") != "succeeded", F.lit(True))
    return evaluation.mode_summary(r.select(F.col("condition.requested").alias("mode"), failed.alias("failed"), F.col("correctness.correctFirst").alias("top1"), F.col("correctness.correctTopFive").alias("top5"), F.col("timing.totalWallNs").alias("value")))


def means_with_errors(spark, folder):
    r = table(spark, folder, "records").select("taskKind", F.coalesce(F.col("status") != "succeeded", F.lit(True)).alias("failed"), F.col("correctness.correctFirst").cast("int").alias("first"), F.col("correctness.passed").cast("int").alias("passed"))
    m = evaluation.means_with_errors(r, "taskKind", ["first", "passed"])
    return m.select("taskKind", "samples", F.round("first", 9).alias("first"), F.round("passed", 9).alias("passed"))


def overlapping_by_phase(spark, folder):
    """Calls of one phase, in whatever workspace, that ran at the same time or within ten minutes."""
    return calllog.overlapping_calls(table(spark, folder, "call_log"), "phase", 600)


def conflicting_spellings(spark, folder):
    """Lines of files given twice, as they are and in lower case: those whose texts differ."""
    c = L._chunks(spark, folder)
    both = chunking.chunk_lines(c).unionByName(chunking.chunk_lines(c.withColumn("text", F.lower("text"))))
    return both.groupBy("path", "line").agg(F.count_distinct("line_text").alias("texts")).where("texts > 1")


NAMES = [
    named_definitions, missing_names, definition_pins, pinned_list, merged_candidates, runner_ups, further_candidates, region_per_file, joined_lists, changed_evidence, chosen_actions, distinct_evidence,
    copies_by_name, distinct_sources, scope_of_directory, text_cuts, path_languages, question_expansions, question_classes, answer_budgets, id_hits, mode_summary, means_with_errors,
    overlapping_by_phase, conflicting_spellings,
]
QUERIES = {f.__name__: f for f in NAMES}

_DEFS = f"{L._SYM}, defs AS (SELECT DISTINCT s.name, s.path, c.start_line, c.end_line FROM sym s JOIN chunks c USING (chunk_id))"
_WANTED = "wanted AS (SELECT qid, name, length(name) AS ord FROM (SELECT qid, name FROM shortlist JOIN sym USING (chunk_id) UNION SELECT qid, lower(name) FROM shortlist JOIN sym USING (chunk_id)))"
_FOUND = """found AS (SELECT w.*, d.name AS defined, d.path, d.start_line, d.end_line, 0 AS level FROM wanted w JOIN defs d ON d.name = w.name
  UNION ALL SELECT w.*, d.name, d.path, d.start_line, d.end_line, 1 FROM wanted w JOIN defs d ON lower(d.name) = lower(w.name) WHERE NOT EXISTS (SELECT 1 FROM defs e WHERE e.name = w.name))"""
_PINS = f"""h AS (SELECT f.*, {L._ISTEST} AS test, f.defined = f.name AND NOT {L._ISTEST} AS top, q.question,
    contains(' ' || regexp_replace(q.question, '[^A-Za-z0-9_./-]+', ' ', 'g') || ' ', ' ' || split_part(path, '/', -1) || ' ') OR contains(' ' || regexp_replace(q.question, '[^A-Za-z0-9_./-]+', ' ', 'g') || ' ', ' ' || path || ' ') AS hint
    FROM found f JOIN questions q USING (qid)),
  i AS (SELECT *, count(*) FILTER (NOT test) OVER g AS plain, bool_or(hint) OVER g AS hinted, count(*) FILTER (top) OVER g AS tops, count(*) OVER g AS n FROM h WINDOW g AS (PARTITION BY qid, name)),
  j AS (SELECT * FROM i WHERE plain < 5 OR hint OR (NOT hinted AND tops = 1 AND top)),
  k AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, name ORDER BY hint DESC, test, starts_with(defined, '_'), length(path), path, start_line) = 1),
  l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY qid, path, start_line, end_line ORDER BY ord, name) = 1),
  pins AS (SELECT qid, name, row_number() OVER (PARTITION BY qid ORDER BY ord, name) AS place, path, start_line, end_line, n - 1 AS others FROM l QUALIFY place <= 3)"""
_MERGED = """m0 AS (SELECT qid, path, start_line, end_line, max(CASE WHEN NOT coalesce(connected, false) THEN score END) AS own, max(score) AS anys, bool_and(coalesce(connected, false)) AS connected FROM candidate_scores GROUP BY ALL),
  m1 AS (SELECT qid, path, start_line, end_line, connected, CASE WHEN connected THEN anys * 0.4 ELSE own END AS score FROM m0),
  merged AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(score, 0) DESC, path, start_line, end_line) AS place FROM m1),
  judged AS (SELECT *, coalesce(score > 0.5 AND place <= 5, false) AS result FROM merged)"""
_ESC = r"strlen(left(t, CAST(k AS INTEGER))) + len(regexp_extract_all(left(t, CAST(k AS INTEGER)), '[\\\"\n\r\t\x08\f]')) + 5 * len(regexp_extract_all(left(t, CAST(k AS INTEGER)), '[\x00-\x07\x0b\x0e-\x1f]'))"
_CUT = lambda size, most: f"left(t, CAST(list_max(list_filter(range(0, {most} + 1), lambda k: {size} <= {most})) AS INTEGER))"
_BYTES = "strlen(left(t, CAST(k AS INTEGER)))"
_SKIP = L._in(X.SKIPPED)
_LANGUAGE = " ".join(f"WHEN split_part(path, '.', -1) IN ({L._in(e)}) THEN '{n}'" for n, e in X.LANGUAGES.items())
_WORDS = "list_filter(regexp_split_to_array(lower(question), '[^\\p{L}\\p{N}'']+'), lambda w: w <> '')"
_LINES_OF = r"""(SELECT path, unnest(range(start_line, end_line + 1)) AS line, unnest(l) AS t FROM (SELECT path, start_line, end_line, CASE WHEN l[-1] = '' AND len(l) > end_line - start_line + 1 THEN l[:len(l) - 1] ELSE l END AS l
    FROM (SELECT path, start_line, end_line, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM chunks)) WHERE len(l) = end_line - start_line + 1)"""

ORACLE = {
    "named_definitions": f"WITH {_DEFS}, {_WANTED}, {_FOUND} SELECT qid, name, level, path, start_line FROM found",
    "missing_names": f"WITH {_DEFS}, {_WANTED} SELECT qid, name FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE lower(d.name) = lower(w.name))",
    "definition_pins": f"WITH {_DEFS}, {_WANTED}, {_FOUND}, {_PINS} SELECT * FROM pins",
    "pinned_list": f"""WITH {_DEFS}, {_WANTED}, {_FOUND}, {_PINS}, {L._GIVEN}, u AS (SELECT qid, path, start_line, end_line, place AS o, true AS pinned FROM pins
      UNION ALL SELECT qid, path, start_line, end_line, rn, false FROM g WHERE NOT EXISTS (SELECT 1 FROM pins p WHERE p.qid = g.qid AND p.path = g.path AND p.start_line = g.start_line AND p.end_line = g.end_line))
      SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pinned DESC, o, path, start_line, end_line) AS rank, path, start_line, end_line, pinned FROM u QUALIFY rank <= 60 OR pinned""",
    "merged_candidates": f"WITH {_MERGED} SELECT * FROM merged",
    "runner_ups": f"WITH {_MERGED} SELECT qid, path, start_line, end_line, score FROM judged WHERE NOT result AND score >= 0.35 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 2",
    "further_candidates": f"""WITH {_MERGED} SELECT qid, path, start_line, end_line, place FROM judged j WHERE (score IS NULL OR score >= 0.2) AND NOT EXISTS (SELECT 1 FROM judged s WHERE s.result AND s.qid = j.qid AND s.path = j.path AND s.start_line <= j.end_line AND j.start_line <= s.end_line)
      QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) <= 6""",
    "region_per_file": f"WITH {L._GIVEN}, b AS (SELECT qid, path, start_line, end_line, rn AS rank FROM g QUALIFY row_number() OVER (PARTITION BY qid, path ORDER BY rn, start_line) = 1) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, path) AS place FROM b",
    "joined_lists": f"""WITH {L._GIVEN}, {_MERGED}, u AS (SELECT qid, path, start_line, end_line, 0 AS l, rn AS p FROM g UNION ALL SELECT qid, path, start_line, end_line, 1, place FROM merged m
      WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.qid = m.qid AND g.path = m.path AND g.start_line = m.start_line AND g.end_line = m.end_line))
      SELECT qid, path, start_line, end_line, row_number() OVER (PARTITION BY qid ORDER BY l, p, path, start_line, end_line) AS place FROM u""",
    "changed_evidence": "WITH a AS (SELECT DISTINCT qid, path, start_line, end_line FROM shortlist), b AS (SELECT DISTINCT qid, path, start_line, end_line FROM candidate_scores) SELECT DISTINCT qid FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))",
    "chosen_actions": """WITH b AS (SELECT qid, path || ':' || start_line AS action, score FROM candidate_scores WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, path || ':' || start_line) = 1)
      SELECT coalesce(q.qid, b.qid) AS qid, CASE WHEN b.score > CASE WHEN q.qid IS NULL THEN -1 ELSE 0.5 END THEN b.action END AS action FROM questions q FULL JOIN b ON b.qid = q.qid""",
    "distinct_evidence": """SELECT qid, path AS label, CAST(count(DISTINCT (start_line, end_line)) AS INTEGER) AS chunks FROM candidate_scores c
      WHERE NOT EXISTS (SELECT 1 FROM shortlist s WHERE s.qid = c.qid AND s.path = c.path AND s.start_line = c.start_line AND s.end_line = c.end_line) GROUP BY qid, path""",
    "copies_by_name": f"""WITH {L._SYM}, few AS (SELECT name FROM sym GROUP BY name HAVING count(DISTINCT path) BETWEEN 2 AND 5 AND count(DISTINCT chunk_id) <= 20), ats AS (SELECT DISTINCT name, chunk_id, path FROM sym JOIN few USING (name)),
      t AS (SELECT chunk_id, list_distinct({L._TOK.format("array_to_string(list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), lambda x: NOT regexp_matches(ltrim(x, ' '), '^(?://|/[*]|[*]|#$|#[^[])')), chr(10))")}) AS w FROM chunks),
      p AS (SELECT a.name, a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, len(list_intersect(x.w, y.w)) / greatest(len(x.w), len(y.w), 1) AS s FROM ats a JOIN ats b ON a.name = b.name AND a.chunk_id < b.chunk_id AND a.path <> b.path JOIN t x ON x.chunk_id = a.chunk_id JOIN t y ON y.chunk_id = b.chunk_id)
      SELECT name, chunk_a, chunk_b, round(s, 9) AS similarity FROM p WHERE s >= 0.9""",
    "distinct_sources": "SELECT md5(text) AS digest, min(id) AS first_id, count(*) AS items FROM rank_items WHERE text IS NOT NULL GROUP BY 1",
    "scope_of_directory": "SELECT workspace, count(DISTINCT path) AS files FROM chunks WHERE starts_with(path, 'src/') GROUP BY 1",
    "text_cuts": f"""WITH d AS (SELECT DISTINCT id, text FROM rank_items WHERE text IS NOT NULL), e AS (SELECT id, text, regexp_replace(text, '^[\\s\\x0b\\x{{85}}\\p{{Z}}]+|[\\s\\x0b\\x{{85}}\\p{{Z}}]+$', '', 'g') AS t FROM d),
      r AS (SELECT id, text, CASE WHEN strlen(t) <= 120 THEN t ELSE {_CUT(_BYTES, 120)} || '…' END AS row FROM e), f AS (SELECT *, text AS t FROM r)
      SELECT id, md5(text) AS of, row, {_CUT(_BYTES, 40)} AS bytes40, {_CUT(_ESC, 60)} AS json60 FROM f""",
    "path_languages": f"SELECT CASE {_LANGUAGE} END AS language, count(DISTINCT path) AS files FROM chunks GROUP BY 1",
    "question_expansions": f"""WITH w AS (SELECT qid, question, list_filter({L._TOK.format("question")}, lambda t: length(t) > 2 AND t NOT IN ({_SKIP})) AS l FROM questions WHERE question IS NOT NULL),
      u AS (SELECT qid, question, list_filter(l, lambda t, i: list_position(l, t) = i)[:16] AS l FROM w),
      z AS (SELECT qid, list_concat([question], list_concat(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]), l)) AS q FROM u)
      SELECT qid, CAST(generate_subscripts(q, 1) - 1 AS INTEGER) AS place, unnest(q) AS query FROM z""",
    "question_classes": f"""WITH c AS (SELECT *, regexp_matches(question, '{Q.UNUSED}') AS unused, strlen(question) <= 120 AND len(list_filter(regexp_split_to_array(question, '\\s+'), lambda w: w <> '')) <= 16 AS brief, {_WORDS} AS w FROM questions WHERE question IS NOT NULL)
      SELECT qid, unused, regexp_matches(question, '{Q.DEPENDENTS}') AS dependents, regexp_matches(question, '{Q.CALLERS}') AS callers, brief AND NOT regexp_matches(question, '{Q.CODE_TOO}') AS alone,
        len(w) >= 6 AND list_has_any(w, [{L._in(Q.CODE_WORDS)}]) AS code_shaped, CASE WHEN unused AND brief THEN 'unused' ELSE 'ranked' END AS route FROM c""",
    "answer_budgets": "SELECT workspace, count(*) AS questions, CAST(least(12, 3 + 2 * (count(*) - 1)) AS BIGINT) AS results, CAST(least(36000, 16000 + 5000 * (count(*) - 1)) AS BIGINT) AS bytes FROM questions GROUP BY 1",
    "id_hits": f"""WITH {L._GIVEN}, {L._GOLD}, x AS (SELECT DISTINCT qid, path FROM gold), j AS (SELECT q.qid, g.rn, x.path IS NOT NULL AS good FROM questions q LEFT JOIN g ON g.qid = q.qid LEFT JOIN x ON x.qid = g.qid AND x.path = g.path)
      SELECT qid, CASE WHEN qid NOT IN (SELECT qid FROM x) THEN count(rn) = 0 ELSE count(*) FILTER (good AND rn = 1) > 0 END AS top1, CASE WHEN qid NOT IN (SELECT qid FROM x) THEN count(rn) = 0 ELSE count(*) FILTER (good AND rn <= 5) > 0 END AS top5 FROM j GROUP BY qid""",
    "mode_summary": """WITH r AS (SELECT condition.requested AS mode, coalesce(status <> 'succeeded', true) AS failed, correctness.correctFirst AS top1, correctness.correctTopFive AS top5, timing.totalWallNs AS v FROM records)
      SELECT mode, count(*) AS runs, count(*) FILTER (failed) AS errors, count(*) FILTER (coalesce(top1, false) AND NOT failed) AS top1, count(*) FILTER (coalesce(top5, false) AND NOT failed) AS top5, quantile_cont(CAST(v AS DOUBLE), 0.5) FILTER (NOT failed) AS median FROM r GROUP BY 1""",
    "means_with_errors": """WITH r AS (SELECT taskKind, coalesce(status <> 'succeeded', true) AS failed, CAST(correctness.correctFirst AS INTEGER) AS f, CAST(correctness.passed AS INTEGER) AS p FROM records)
      SELECT taskKind, count(*) AS samples, round(sum(CASE WHEN failed THEN 0 ELSE coalesce(f, 0) END) / count(*), 9) AS first, round(sum(CASE WHEN failed THEN 0 ELSE coalesce(p, 0) END) / count(*), 9) AS passed FROM r GROUP BY 1""",
    "overlapping_by_phase": """WITH c AS (SELECT entry_id, phase, min(epoch_us(received_at) - ms * 1000) AS s, min(epoch_us(received_at)) + 600000000 AS e FROM call_log WHERE received_at IS NOT NULL AND ms IS NOT NULL AND phase IS NOT NULL GROUP BY ALL)
      SELECT a.entry_id, count(DISTINCT b.entry_id) AS others FROM c a JOIN c b ON a.phase = b.phase AND a.entry_id <> b.entry_id AND a.s < b.e AND b.s < a.e GROUP BY 1""",
    "conflicting_spellings": f"SELECT path, CAST(line AS INTEGER) AS line, 2::BIGINT AS texts FROM (SELECT path, line, t FROM {_LINES_OF} UNION SELECT path, line, lower(t) FROM {_LINES_OF}) GROUP BY ALL HAVING count(*) > 1",
}
