"""Queries on code relations, files and line ranges, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.operators import chunking, index, links, ranges, symbols, usages
from ferrule.plans import lexical as L
from ferrule.sources import files as S
from ferrule.sources.tables import table

_chunks = L._chunks


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.file_lines(_chunks(spark, folder))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Every declared name."""
    return index.symbols(_chunks(spark, folder)).select("name").distinct()


def _uses(spark, folder):
    return usages.word_uses(_lines(spark, folder), _names(spark, folder))


def word_usages(spark, folder):
    return _uses(spark, folder).groupBy("path", "name").agg(F.count(F.lit(1)).alias("uses"), F.min("line").alias("first_line"))


def usage_counts(spark, folder):
    return usages.usage_counts(_uses(spark, folder))


def used_by(spark, folder):
    return usages.used_by(_uses(spark, folder))


def dependents_by_area(spark, folder):
    return usages.dependents(_uses(spark, folder)).select("name", "area", "path", "first_line", "more")


def usage_listing(spark, folder):
    return usages.listing(_uses(spark, folder)).select("name", "path", "line", "kind", "place")


def tests_for(spark, folder):
    c = _chunks(spark, folder)
    return usages.tests_for(_uses(spark, folder), index.symbols(c), c)


def _definitions(spark, folder):
    """From whole files: a definition may run past its chunk."""
    files = chunking.joined_runs(_chunks(spark, folder).where(X.is_code_path("path")))
    return symbols.definitions(files, start_line="start_line")


def definitions(spark, folder):
    return _definitions(spark, folder)


def unused_definitions(spark, folder):
    return usages.unused(_definitions(spark, folder), _lines(spark, folder))


def import_rows(spark, folder):
    return symbols.imports(_lines(spark, folder).where(X.is_code_path("path")))


def enclosing_definition(spark, folder):
    """Lines that mention a declared name, with the definition around them."""
    return ranges.enclosing(_uses(spark, folder).select("path", "line").distinct(), _definitions(spark, folder))


def enclosing_chunk(spark, folder):
    """The smallest shortlisted chunk around the first line of each judged candidate."""
    p = table(spark, folder, "candidate_scores").select("path", F.col("start_line").alias("line")).distinct()
    s = table(spark, folder, "shortlist").select("path", F.col("chunk_id").cast("string").alias("name"), "start_line", "end_line").distinct()
    return ranges.enclosing(p, s)


def overlap_semi_join(spark, folder):
    a = table(spark, folder, "candidate_scores").select("path", "start_line", "end_line").distinct()
    return ranges.overlapping(a, table(spark, folder, "shortlist"))


def unseen_candidates(spark, folder):
    a = table(spark, folder, "candidate_scores").select("path", "start_line", "end_line").distinct()
    return ranges.overlapping(a, table(spark, folder, "shortlist"), "left_anti")


def merged_ranges(spark, folder):
    return ranges.merged(table(spark, folder, "shortlist").select("qid", "path", "start_line", "end_line").distinct(), ["qid", "path"])


def nearest_config(spark, folder):
    p = _chunks(spark, folder).select("path").distinct()
    return ranges.nearest_ancestor(p.where(X.is_code_path("path")), p.where(F.col("path").rlike(r"\.(toml|yml|json)$")))


def connected_files(spark, folder):
    """Files linked to the first five files of the given shortlist."""
    g = L._given(spark, folder).groupBy("qid", "path").agg(F.min("rn").alias("rn"))
    seeds = g.select("qid", "path", F.row_number().over(Window.partitionBy("qid").orderBy("rn")).alias("seed"), F.lit(1.0).alias("weight")).where("seed <= 5")
    return links.connected(_chunks(spark, folder), seeds).select("qid", "path", F.round("score", 6).alias("score"), "rank")


def definers(spark, folder):
    return links.definers(_chunks(spark, folder))


def manifest_changes(spark, folder):
    """Chunks as files, and the same with every tenth text replaced and every eleventh row gone."""
    c = _chunks(spark, folder).select(F.concat_ws(":", "path", "start_line").alias("path"), F.sha2("text", 256).alias("digest"), "chunk_id")
    new = c.where("chunk_id % 11 <> 0").select("path", F.when(F.col("chunk_id") % 10 == 0, "changed").otherwise(F.col("digest")).alias("digest"))
    return S.manifest_changes(c, new)


def coverage_by_extension(spark, folder):
    c = _chunks(spark, folder)
    return c.groupBy(X.extension("path").alias("extension")).agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"))


def conflicting_lines(spark, folder):
    """Lines given more than once with different texts by overlapping chunks."""
    return chunking.chunk_lines(_chunks(spark, folder)).groupBy("path", "line").agg(F.count_distinct("line_text").alias("texts")).where("texts > 1")


def names_by_case(spark, folder):
    """Declared names that differ in case only, for lookups that fall back to lower case."""
    return index.symbols(_chunks(spark, folder)).groupBy(F.lower("name").alias("lower")).agg(F.count_distinct("name").alias("spellings"), F.count(F.lit(1)).alias("n")).where("spellings > 1")


QUERIES = {
    f.__name__: f
    for f in (
        word_usages, usage_counts, used_by, dependents_by_area, usage_listing, tests_for, definitions, unused_definitions, import_rows, enclosing_definition, enclosing_chunk, overlap_semi_join, unseen_candidates,
        merged_ranges, nearest_config, connected_files, definers, manifest_changes, coverage_by_extension, conflicting_lines, names_by_case,
    )
}

_LINES = r"""lines AS (WITH p AS (SELECT path, start_line, end_line, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM chunks),
 q AS (SELECT path, start_line, end_line, CASE WHEN l[-1] = '' AND len(l) > end_line - start_line + 1 THEN l[:len(l) - 1] ELSE l END AS l FROM p),
 r AS (SELECT path, start_line AS s, unnest(range(start_line, end_line + 1)) AS line, unnest(l) AS t FROM q WHERE len(l) = end_line - start_line + 1)
 SELECT path, CAST(line AS INTEGER) AS line, arg_min(t, s) AS line_text FROM r GROUP BY ALL)"""
_USES = f"{L._SYM}, nm AS (SELECT DISTINCT name FROM sym), {_LINES}, w AS (SELECT DISTINCT path, line, line_text, unnest(regexp_extract_all(line_text, '[\\p{{L}}\\p{{N}}_]+')) AS name FROM lines), u0 AS (SELECT w.* FROM w JOIN nm USING (name))"
_C = "(starts_with(x, '//') OR starts_with(x, '/*') OR x = '*' OR starts_with(x, '* ') OR starts_with(x, '*/'))"
_KIND = (
    f"u AS (SELECT *, CASE WHEN CASE WHEN ext IN ({L._in(X.HASH_COMMENTS)}) THEN starts_with(x, '#') WHEN ext IN ({L._in(X.DASH_COMMENTS)}) THEN starts_with(x, '--') WHEN ext IN ({L._in(X.MARKUP_COMMENTS)}) THEN starts_with(x, '<!--') ELSE {_C} END THEN 'mention'"
    f" WHEN regexp_matches(line_text, '{X.IMPORT_LINE.replace(chr(39), chr(39) * 2)}') THEN 'import' WHEN regexp_matches(line_text, '(^|[^\\p{{L}}\\p{{N}}_])' || name || '[! ]*(?:::<[^>]*>?)?\\(') THEN 'call' ELSE 'reference' END AS kind"
    f" FROM (SELECT *, ltrim(line_text, ' ') AS x, {L._EXT} AS ext, {L._ISTEST} AS is_test, {L._EXT} IN ({L._in(X.DOCS_EXTENSIONS)}) AS is_docs FROM u0))"
)
_AREA = "CASE WHEN len(string_split(path, '/')) <= 1 THEN '.' WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] ELSE string_split(path, '/')[1] || '/' || string_split(path, '/')[2] END"

ORACLE = {
    "word_usages": f"WITH {_USES} SELECT path, name, count(*) AS uses, min(line) AS first_line FROM u0 GROUP BY ALL",
    "usage_counts": f"""WITH {_USES}, {_KIND} SELECT name, count(*) FILTER (NOT is_test AND NOT is_docs AND kind = 'call') AS calls, count(*) FILTER (NOT is_test AND NOT is_docs AND kind = 'import') AS imports,
      count(*) FILTER (NOT is_test AND NOT is_docs AND kind = 'reference') AS refs, count(*) FILTER (NOT is_test AND NOT is_docs AND kind = 'mention') AS mentions, count(*) FILTER (is_test) AS hidden_tests, count(*) FILTER (NOT is_test AND is_docs) AS hidden_docs FROM u GROUP BY name""",
    "used_by": f"WITH {_USES} SELECT name, path, count(*) AS uses, min(line) AS first_line, {L._ISTEST} AS is_test FROM u0 GROUP BY name, path",
    "dependents_by_area": f"WITH {_USES}, {_KIND} SELECT name, {_AREA} AS area, path, min(line) AS first_line, count(*) - 1 AS more FROM u WHERE NOT is_docs AND kind <> 'mention' GROUP BY name, path",
    "usage_listing": f"""WITH {_USES}, {_KIND}, v AS (SELECT * FROM u WHERE NOT is_test AND NOT is_docs AND kind <> 'mention'), n AS (SELECT name, path, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, path) AS f FROM v GROUP BY name, path),
      z AS (SELECT v.name, v.path, v.line, v.kind, row_number() OVER (PARTITION BY v.name ORDER BY n.f, v.line) AS place FROM v JOIN n ON n.name = v.name AND n.path = v.path WHERE n.f <= 12) SELECT * FROM z WHERE place <= 40""",
    "enclosing_chunk": """WITH p AS (SELECT DISTINCT path, start_line AS line FROM candidate_scores), s AS (SELECT DISTINCT path, CAST(chunk_id AS VARCHAR) AS name, start_line, end_line FROM shortlist),
      j AS (SELECT p.path, p.line, s.name, s.start_line, s.end_line, row_number() OVER (PARTITION BY p.path, p.line ORDER BY s.end_line - s.start_line, s.start_line, s.name) AS rn FROM p LEFT JOIN s ON s.path = p.path AND p.line BETWEEN s.start_line AND s.end_line)
      SELECT path, line, name, start_line, end_line FROM j WHERE rn = 1""",
    "overlap_semi_join": "SELECT DISTINCT path, start_line, end_line FROM candidate_scores c WHERE EXISTS (SELECT 1 FROM shortlist s WHERE s.path = c.path AND s.start_line <= c.end_line AND c.start_line <= s.end_line)",
    "unseen_candidates": "SELECT DISTINCT path, start_line, end_line FROM candidate_scores c WHERE NOT EXISTS (SELECT 1 FROM shortlist s WHERE s.path = c.path AND s.start_line <= c.end_line AND c.start_line <= s.end_line)",
    "merged_ranges": """WITH r AS (SELECT DISTINCT qid, path, start_line, end_line FROM shortlist), a AS (SELECT *, max(end_line) OVER (PARTITION BY qid, path ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM r),
      i AS (SELECT *, sum(CASE WHEN b IS NULL OR start_line > b + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, path ORDER BY start_line, end_line ROWS UNBOUNDED PRECEDING) AS island FROM a)
      SELECT qid, path, min(start_line) AS start_line, max(end_line) AS end_line, count(*) AS parts FROM i GROUP BY qid, path, island""",
    "nearest_config": f"""WITH p AS (SELECT DISTINCT path FROM chunks), f AS (SELECT path FROM p WHERE regexp_matches(path, '{X.CODE_PATH}')), c AS (SELECT path AS config, regexp_replace(path, '/?[^/]*$', '') AS dir FROM p WHERE regexp_matches(path, '\\.(toml|yml|json)$')),
      j AS (SELECT f.path, c.config, row_number() OVER (PARTITION BY f.path ORDER BY length(c.dir) - length(replace(c.dir, '/', '')) + CASE WHEN c.dir = '' THEN 0 ELSE 1 END DESC NULLS LAST, c.config) AS rn FROM f LEFT JOIN c ON c.dir = '' OR starts_with(f.path, c.dir || '/'))
      SELECT path, config FROM j WHERE rn = 1""",
    "definers": f"WITH d AS (SELECT DISTINCT path, unnest({L._NAMES_BY(links.LINKED, 2)}) AS name FROM chunks), e AS (SELECT * FROM d WHERE length(name) >= 4) SELECT path, name FROM e WHERE name IN (SELECT name FROM e GROUP BY name HAVING count(*) <= 5)",
    "manifest_changes": """WITH o AS (SELECT path || ':' || start_line AS path, sha256(text) AS digest, chunk_id FROM chunks), n AS (SELECT path, CASE WHEN chunk_id % 10 = 0 THEN 'changed' ELSE digest END AS digest FROM o WHERE chunk_id % 11 <> 0)
      SELECT * FROM (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.digest <> n.digest THEN 'changed' END AS change FROM o FULL JOIN n ON o.path = n.path) WHERE change IS NOT NULL""",
    "coverage_by_extension": f"SELECT {L._EXT} AS extension, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks GROUP BY 1",
    "conflicting_lines": r"""WITH p AS (SELECT path, start_line, end_line, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM chunks),
      q AS (SELECT path, start_line, end_line, CASE WHEN l[-1] = '' AND len(l) > end_line - start_line + 1 THEN l[:len(l) - 1] ELSE l END AS l FROM p),
      r AS (SELECT path, unnest(range(start_line, end_line + 1)) AS line, unnest(l) AS t FROM q WHERE len(l) = end_line - start_line + 1)
      SELECT path, CAST(line AS INTEGER) AS line, count(DISTINCT t) AS texts FROM r GROUP BY ALL HAVING count(DISTINCT t) > 1""",
    "names_by_case": f"WITH {L._SYM} SELECT lower(name) AS lower, count(DISTINCT name) AS spellings, count(*) AS n FROM sym GROUP BY 1 HAVING count(DISTINCT name) > 1",
    "connected_files": f"""WITH {L._GIVEN}, sd AS (SELECT qid, path, row_number() OVER (PARTITION BY qid ORDER BY min(rn)) AS seed FROM g GROUP BY qid, path QUALIFY seed <= 5),
      d0 AS (SELECT DISTINCT path, unnest({L._NAMES_BY(links.LINKED, 2)}) AS name FROM chunks), d1 AS (SELECT * FROM d0 WHERE length(name) >= 4), d AS (SELECT path, name FROM d1 WHERE name IN (SELECT name FROM d1 GROUP BY name HAVING count(*) <= 5)),
      m AS (SELECT DISTINCT path, name FROM (SELECT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM chunks) WHERE length(name) >= 4 AND NOT regexp_matches(name, '^[0-9]') AND name IN (SELECT name FROM d)),
      rare AS (SELECT name, ln(1 + (SELECT count(DISTINCT path) FROM chunks) / count(*)) * CASE WHEN starts_with(name, '_') THEN 0.3 ELSE 1 END AS r FROM m GROUP BY name),
      sh AS (SELECT sd.qid, sd.seed, d.name, m.path AS file FROM sd JOIN d ON d.path = sd.path JOIN m ON m.name = d.name UNION SELECT sd.qid, sd.seed, m.name, d.path FROM sd JOIN m ON m.path = sd.path JOIN d ON d.name = m.name),
      fi AS (SELECT DISTINCT qid, file, name FROM sh WHERE NOT EXISTS (SELECT 1 FROM sd WHERE sd.qid = sh.qid AND sd.path = sh.file)),
      bn AS (SELECT qid, file, sum(r) AS s FROM fi JOIN rare USING (name) GROUP BY ALL),
      st AS (SELECT DISTINCT path, regexp_replace(regexp_replace(regexp_replace(split_part(lower(split_part(path, '/', -1)), '.', 1), '^test_', ''), '(_test|_tests|_spec|test|tests|spec)$', ''), '^[-_]+|[-_]+$', '', 'g') AS stem, {L._ISTEST} AS t FROM chunks),
      pr AS (SELECT sd.qid, b.path AS file, 1000.0 * count(*) AS s FROM sd JOIN st a ON a.path = sd.path JOIN st b ON b.stem = a.stem AND b.t <> a.t WHERE length(b.stem) >= 3 AND NOT EXISTS (SELECT 1 FROM sd x WHERE x.qid = sd.qid AND x.path = b.path) GROUP BY ALL),
      al AS (SELECT qid, file, sum(s) AS s FROM (SELECT * FROM bn UNION ALL SELECT * FROM pr) GROUP BY ALL)
      SELECT qid, file AS path, round(s, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, file) AS rank FROM al QUALIFY rank <= 30""",
}
