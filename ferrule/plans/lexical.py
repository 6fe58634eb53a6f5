"""Queries on text, index statistics and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import questions as Q
from ferrule.functions import text as X
from ferrule.functions.stem import stems
from ferrule.operators import chunking, evaluation, index, ranking, requests
from ferrule.session import materialize, spread
from ferrule.sources.tables import table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "chunks").select("chunk_id", "workspace", "path", "start_line", "end_line", "text"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """documents as files with a made-up path."""
    return table(spark, folder, "documents").select("doc_id", F.format_string("docs/%s/doc_%d.md", F.coalesce("lang", F.lit("none")), F.col("doc_id")).alias("path"), "text")


def tokenize_chunks(spark, folder):
    return _chunks(spark, folder).select("chunk_id", F.array_join(X.tokens("text"), " ").alias("tokens"))


def path_features(spark, folder):
    p = _chunks(spark, folder).select("path").distinct()
    return p.select("path", X.is_test_path("path").alias("is_test"), X.is_docs_path("path").alias("is_docs"), X.is_data_path("path").alias("is_data"), X.is_code_path("path").alias("is_code"), X.area_of("path").alias("area"), X.file_stem("path").alias("stem"))


def text_features(spark, folder):
    i = table(spark, folder, "rank_items").where("text IS NOT NULL").select("id", "text").distinct()
    return i.select("id", X.utf16_length("id").alias("id_units"), X.escaped_length("text").alias("json_bytes"), F.sha2("text", 256).alias("digest"), X.snippet("text").alias("snippet"), X.leaf_of("id").alias("leaf"))


def validated_items(spark, folder):
    return requests.valid_items(table(spark, folder, "rank_items")).groupBy(F.coalesce("violation", F.lit("valid")).alias("violation")).agg(F.count(F.lit(1)).alias("items"))


def chunk_documents(spark, folder):
    return chunking.chunk_plain(_files(spark, folder)).select("path", "start_line", "end_line", F.md5("text").alias("text_md5"))


def chunk_lines(spark, folder):
    lines = chunking.chunk_lines(_chunks(spark, folder))
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"), F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.sum(F.length("line_text")).alias("chars"))


def term_frequencies(spark, folder):
    return index.term_frequencies(_chunks(spark, folder), "chunk_id", "text").select(F.col("key").alias("chunk_id"), "term", "tf", "len")


def document_frequencies(spark, folder):
    return index.term_frequencies(_chunks(spark, folder), "chunk_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def field_stats(spark, folder):
    c = _chunks(spark, folder)
    return index.field_stats(c, "text").withColumn("field", F.lit("content")).unionByName(index.field_stats(c, "path").withColumn("field", F.lit("path")))


def declared_symbols(spark, folder):
    return index.symbols(_chunks(spark, folder)).groupBy("chunk_id", "name").agg(F.count(F.lit(1)).alias("n"))


def reference_weights(spark, folder):
    c = _chunks(spark, folder)
    names = materialize(index.symbols(c), "symbols")
    return index.reference_weights(names, index.identifiers(c, names)).select("path", "name", F.round("weight", 9).alias("weight"))


def question_terms(spark, folder):
    return ranking.question_terms(table(spark, folder, "questions"))


def bm25_content(spark, folder):
    q = ranking.question_terms(table(spark, folder, "questions"))
    return ranking.bm25(_chunks(spark, folder), "chunk_id", "text", q, ("qid", "chunk_id", "score"), 6)


def bm25_baseline(spark, folder):
    q = ranking.question_terms(table(spark, folder, "questions"))
    return ranking.baseline(_chunks(spark, folder), q, ("qid", "chunk_id", "baseline"), 6)


def symbol_scores(spark, folder):
    q = ranking.question_terms(table(spark, folder, "questions"))
    return ranking.symbol_scores(_chunks(spark, folder), q).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def shortlist(spark, folder):
    """The whole ranking with stems and symbols."""
    s = ranking.shortlist(_chunks(spark, folder), table(spark, folder, "questions"), stemmed=True)
    return s.select("qid", "rank", "chunk_id", F.round("lexical_score", 6).alias("lexical_score"))


def shortlist_neighbours(spark, folder):
    """The neighbours that the ranking lifts into the last places."""
    scored, kept = ranking.scored_and_kept(_chunks(spark, folder), table(spark, folder, "questions"))
    return ranking.neighbours(scored, kept).select("qid", "chunk_id", "rank")


def _given(spark, folder):
    """The given shortlist, each chunk once, ranked by its score."""
    s = table(spark, folder, "shortlist").groupBy("qid", "chunk_id", "path", "start_line", "end_line").agg(F.max("lexical_score").alias("s"))
    w = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "chunk_id"))
    return s.withColumn("rn", w)


def rrf_fusion(spark, folder):
    """The given shortlist and the judged candidates as two lists, fused."""
    a = _given(spark, folder).select("qid", "chunk_id", (F.col("rn") - 1).alias("rank0"), F.lit(0).alias("list_no"))
    c = table(spark, folder, "candidate_scores").where("score IS NOT NULL").groupBy("qid", "path", "start_line", "end_line").agg(F.max("score").alias("s"))
    c = c.join(_chunks(spark, folder).drop("text", "workspace"), ["path", "start_line", "end_line"])
    w = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "chunk_id"))
    b = c.select("qid", "chunk_id", (w - 1).alias("rank0"), F.lit(1).alias("list_no"))
    return ranking.fuse_rankings(a.unionByName(b))


def overlap_suppressed(spark, folder):
    return ranking.suppress_overlaps(_given(spark, folder)).select("qid", "rank", "chunk_id")


def implementation_quota(spark, folder):
    tests = ranking.about_tests(table(spark, folder, "questions"))
    return ranking.implementation_quota(_given(spark, folder), tests=tests).select("qid", "rank", "chunk_id")


def fused_shortlist(spark, folder):
    """The fused, de-overlapped list of each question in its workspace, by words as they are, before neighbours."""
    _, kept = ranking.scored_and_kept(_chunks(spark, folder), table(spark, folder, "questions"))
    return kept.select("qid", "rank", "chunk_id")


def round_robin_merge(spark, folder):
    """Questions of a workspace take turns."""
    g = _given(spark, folder).join(table(spark, folder, "questions").select("qid", "workspace"), "qid")
    return ranking.round_robin(g, "workspace", "rn", "qid").select("workspace", "qid", "chunk_id", "place")


def request_budget_cut(spark, folder):
    g = _given(spark, folder).join(_chunks(spark, folder).select("chunk_id", "text"), "chunk_id")
    return requests.cut_to_budget(g, "qid", "rn", "text", 1000, 48_000).select("qid", "chunk_id", "bytes", "total")


def judged_results(spark, folder):
    c = table(spark, folder, "candidate_scores").where("score IS NOT NULL").groupBy("qid", "path", "start_line").agg(F.max("score").alias("score"))
    return requests.judged_order(c.withColumn("pos", F.concat_ws(":", "path", F.lpad(F.col("start_line").cast("string"), 9, "0"))), "qid", "score", "pos").select("qid", "path", "start_line", "place", "result")


def _gold(spark, folder):
    return table(spark, folder, "candidate_scores").where("score > 0.5").select("qid", "path", "start_line", "end_line").distinct()


def recall_mrr(spark, folder):
    r = _given(spark, folder).select("qid", F.col("path").alias("item"), F.col("rn").alias("rank"))
    e = evaluation.recall_mrr(r, _gold(spark, folder).select("qid", F.col("path").alias("item")))
    return e.select("qid", "gold", *[F.round(c, 9).alias(c) for c in ("recall_at_5", "recall_at_20", "mrr")])


def range_hits(spark, folder):
    return evaluation.range_hits(_given(spark, folder).withColumnRenamed("rn", "rank"), _gold(spark, folder))


def accuracy_at_20(spark, folder):
    r = _given(spark, folder).select("qid", F.col("path").alias("item"), F.col("rn").alias("rank"))
    return evaluation.accuracy_at(r, _gold(spark, folder).select("qid", F.col("path").alias("item")), 20)


def excerpt_coverage(spark, folder):
    g = _given(spark, folder)
    return evaluation.coverage(_gold(spark, folder), g.where("rn <= 5").select("qid", "path", "start_line", "end_line"), g.select("qid", "path")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def dev_split(spark, folder):
    return evaluation.split_of(table(spark, folder, "questions"), "qid")


def question_intents(spark, folder):
    q = table(spark, folder, "questions").where("question IS NOT NULL").select("qid", F.col("question").alias("q"))
    c = F.col("q")
    return q.select("qid", Q.asks_for_unused(c).alias("unused"), Q.asks_for_callers(c).alias("callers"), Q.stands_alone(c).alias("alone"), Q.asks_for_tests(c).alias("tests"))


def prompt_gate(spark, folder):
    q = table(spark, folder, "questions").where("question IS NOT NULL")
    q = q.select("qid", "question", Q.code_names("question").alias("names"))
    return q.select("qid", Q.gate_reason(F.col("question"), F.col("names")).alias("reason"), "names")


def porter_stems(spark, folder):
    return stems(table(spark, folder, "questions").where("question IS NOT NULL").select(F.explode(X.tokens("question")).alias("term")))


NAMES = [
    tokenize_chunks, path_features, text_features, validated_items, chunk_documents, chunk_lines, term_frequencies, document_frequencies, field_stats, declared_symbols, reference_weights, question_terms,
    bm25_content, bm25_baseline, symbol_scores, shortlist, fused_shortlist, shortlist_neighbours, rrf_fusion, overlap_suppressed, implementation_quota, round_robin_merge, request_budget_cut, judged_results,
    recall_mrr, range_hits, accuracy_at_20, excerpt_coverage, dev_split, question_intents, prompt_gate, porter_stems,
]
QUERIES = {f.__name__: f for f in NAMES}

_TOK = r"regexp_extract_all(lower(regexp_replace(regexp_replace({}, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[a-z0-9]+')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TF = f"WITH toks AS (SELECT chunk_id AS key, {_TOK.format('text')} AS t FROM chunks), tf AS (SELECT key, term, count(*) AS tf, any_value(l) AS len FROM (SELECT key, len(t) AS l, unnest(t) AS term FROM toks) GROUP BY key, term)"
_QT = f"qt AS (SELECT DISTINCT qid, term FROM (SELECT qid, unnest({_TOK.format('question')}) AS term FROM questions) WHERE term NOT IN ({_STOP}))"
_SCORE = """x{0} AS (SELECT qt.qid, f.key AS chunk_id, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.len / (s.total / s.n)))) AS score
  FROM qt JOIN {1} f ON f.term = qt.term JOIN (SELECT term, count(*) AS df FROM {1} GROUP BY term) d ON d.term = qt.term
  CROSS JOIN (SELECT count(*) AS n, sum(len(t)) AS total FROM {2}) s GROUP BY 1, 2)"""
_PATH = f"ptoks AS (SELECT chunk_id AS key, {_TOK.format('path')} AS t FROM chunks), ptf AS (SELECT key, term, count(*) AS tf, any_value(l) AS len FROM (SELECT key, len(t) AS l, unnest(t) AS term FROM ptoks) GROUP BY key, term)"
_GIVEN = """g AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) AS rn FROM
  (SELECT qid, chunk_id, path, start_line, end_line, max(lexical_score) AS s FROM shortlist GROUP BY ALL))"""
_GOLD = "gold AS (SELECT DISTINCT qid, path, start_line, end_line FROM candidate_scores WHERE score > 0.5)"
_NAMES_BY = lambda p, n: f"list_transform(regexp_extract_all(text, '{p}', 0), lambda m: regexp_replace(m, '{p}', '{chr(92).join(['', *map(str, range(1, n + 1))])}'))"
_PLAIN, _TYPED = _NAMES_BY(index.SYMBOL, 6), _NAMES_BY(index.TYPED_SYMBOL, 1)
_SYM = f"sym AS (SELECT chunk_id, path, unnest(CASE WHEN regexp_matches(path, '{X.TYPED_PATH}') THEN {_TYPED} ELSE {_PLAIN} END) AS name FROM chunks WHERE regexp_matches(path, '{X.CODE_PATH}'))"
_WEIGHT = f"""ident AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS name FROM chunks WHERE regexp_matches(path, '{X.CODE_PATH}')),
 wt AS (SELECT n.path, n.name, 1 + least(ln(1 + coalesce(f.files, 0) - CASE WHEN o.name IS NULL THEN 0 ELSE 1 END), 2) AS weight
  FROM (SELECT DISTINCT path, name FROM sym) n LEFT JOIN (SELECT name, count(*) AS files FROM ident GROUP BY name) f ON f.name = n.name LEFT JOIN ident o ON o.path = n.path AND o.name = n.name)"""
_ISTEST = f"regexp_matches(path, '{X.TEST_PATH}')"
_EXT = "lower(split_part(path, '.', -1))"
_in = lambda ws: ", ".join(f"'{w}'" for w in ws)
_Q = lambda p: p.replace("'", "''")

_FOLD = """list_reduce(list_transform(list({{'rn': rn, 'c': chunk_id, 's': start_line, 'e': end_line}} ORDER BY rn), lambda x: [x]), lambda a, b: CASE WHEN len(list_filter(a, lambda k:
  least(k.e, b[1].e) - greatest(k.s, b[1].s) + 1 >= ceil((least(k.e - k.s, b[1].e - b[1].s) + 1) / 2))) > 0 THEN a ELSE list_concat(a, b) END)"""
_KEPT = lambda rows, most: f"SELECT qid, path, u.c AS chunk_id, u.s AS start_line, u.e AS end_line, row_number() OVER (PARTITION BY qid ORDER BY u.rn, u.c) AS rank FROM (SELECT qid, path, unnest({_FOLD.format()}) AS u FROM {rows} GROUP BY qid, path) QUALIFY rank <= {most}"
_SCOPED = "JOIN chunks c ON c.chunk_id = x.chunk_id JOIN questions q ON q.qid = x.qid AND q.workspace = c.workspace"

ORACLE = {
    "overlap_suppressed": f"WITH {_GIVEN} SELECT qid, rank, chunk_id FROM ({_KEPT('g', 60)})",
    "fused_shortlist": _TF + f", {_QT}, {_PATH}, " + _SCORE.format("c", "tf", "toks") + ", " + _SCORE.format("p", "ptf", "ptoks") + f""", {_SYM}, {_WEIGHT}, nsym AS (SELECT *, row_number() OVER () AS o FROM sym), stoks AS (SELECT o AS key, {_TOK.format('name')} AS t FROM nsym),
      stf AS (SELECT key, term, count(*) AS tf, any_value(l) AS len FROM (SELECT key, len(t) AS l, unnest(t) AS term FROM stoks) GROUP BY key, term), """ + _SCORE.format("s", "stf", "stoks") + f""",
      ys AS (SELECT xs.qid, n.chunk_id, max(xs.score * w.weight) AS score FROM xs JOIN nsym n ON n.o = xs.chunk_id JOIN wt w ON w.path = n.path AND w.name = n.name GROUP BY 1, 2),
      al AS (SELECT qid, chunk_id, sum(b) AS base, sum(b) + sum(s) AS aware FROM (SELECT qid, chunk_id, score AS b, 0.0 AS s FROM xc UNION ALL SELECT qid, chunk_id, 0.3 * score, 0.0 FROM xp UNION ALL SELECT qid, chunk_id, 0.0, score FROM ys) GROUP BY ALL),
      sc AS (SELECT x.qid, x.chunk_id, round(base, 9) AS base, round(aware, 9) AS aware, c.path, c.start_line, c.end_line FROM al x {_SCOPED}),
      la AS (SELECT qid, chunk_id, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY base DESC, path, start_line, end_line)) AS r FROM sc WHERE base > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY base DESC, path, start_line, end_line) <= 120
        UNION ALL SELECT qid, chunk_id, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY aware DESC, path, start_line, end_line)) FROM sc WHERE aware > 0 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY aware DESC, path, start_line, end_line) <= 120),
      fu AS (SELECT qid, chunk_id, round(sum(r), 12) AS f FROM la GROUP BY ALL),
      od AS (SELECT fu.qid, fu.chunk_id, sc.path, sc.start_line, sc.end_line, row_number() OVER (PARTITION BY fu.qid ORDER BY f DESC, sc.path, sc.start_line, sc.end_line) AS rn FROM fu JOIN sc ON sc.qid = fu.qid AND sc.chunk_id = fu.chunk_id)
      SELECT qid, rank, chunk_id FROM ({_KEPT('od', 60)})""",
    "implementation_quota": f"""WITH {_GIVEN}, tq AS (SELECT DISTINCT qid FROM (SELECT qid, unnest({_TOK.format('question')}) AS t FROM questions) WHERE t IN ('test', 'tests', 'tested', 'testing', 'spec', 'specs', 'fixture', 'fixtures')),
      la AS (SELECT * FROM g WHERE regexp_matches(path, '{X.CODE_PATH}') AND (qid IN (SELECT qid FROM tq) OR NOT {_ISTEST})), fi AS ({_KEPT('la', 30)}),
      un AS (SELECT qid, rank AS rn, chunk_id, path, start_line, end_line FROM fi UNION ALL SELECT qid, rn + 1000000, chunk_id, path, start_line, end_line FROM g WHERE NOT EXISTS (SELECT 1 FROM fi WHERE fi.qid = g.qid AND fi.chunk_id = g.chunk_id))
      SELECT qid, rank, chunk_id FROM ({_KEPT('un', 60)})""",
    "tokenize_chunks": f"SELECT chunk_id, array_to_string({_TOK.format('text')}, ' ') AS tokens FROM chunks",
    "path_features": f"""SELECT DISTINCT path, {_ISTEST} AS is_test, {_EXT} IN ({_in(X.DOCS_EXTENSIONS)}) AS is_docs,
      {_EXT} IN ({_in(X.DATA_EXTENSIONS)}) OR regexp_matches(lower(path), '^(scripts?|db)/|/(fixtures|locales|locale|generated)/|\\.min\\.js$') AS is_data,
      regexp_matches(path, '{X.CODE_PATH}') AS is_code,
      CASE WHEN len(string_split(path, '/')) <= 1 THEN '.' WHEN len(string_split(path, '/')) = 2 THEN string_split(path, '/')[1] ELSE string_split(path, '/')[1] || '/' || string_split(path, '/')[2] END AS area,
      regexp_replace(regexp_replace(regexp_replace(split_part(lower(split_part(path, '/', -1)), '.', 1), '^test_', ''), '(_test|_tests|_spec|test|tests|spec)$', ''), '^[-_]+|[-_]+$', '', 'g') AS stem FROM chunks""",
    "text_features": r"""SELECT DISTINCT id, CAST(length(id) AS INTEGER) AS id_units,
      CAST(strlen(text) + len(regexp_extract_all(text, '[\\"\n\r\t\x08\f]')) + 5 * len(regexp_extract_all(text, '[\x00-\x07\x0b\x0e-\x1f]')) AS INTEGER) AS json_bytes, sha256(text) AS digest,
      CASE WHEN len(string_split(text, chr(10))) > 8 THEN array_to_string(string_split(text, chr(10))[1:8], chr(10)) || chr(10) || '…' ELSE text END AS snippet,
      string_split_regex(id, '[.#:]')[-1] AS leaf FROM rank_items WHERE text IS NOT NULL""",
    "validated_items": r"""WITH v AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM rank_items)
      SELECT CASE WHEN coalesce(regexp_replace(id, '[\s\x{00a0}\x{feff}]+', '', 'g') = '', true) THEN 'blank_id' WHEN length(id) > 200 THEN 'long_id' WHEN n > 1 THEN 'duplicate_id'
        WHEN coalesce(regexp_replace(text, '[\s\x{00a0}\x{feff}]+', '', 'g') = '', true) THEN 'blank_text' ELSE 'valid' END AS violation, count(*) AS items FROM v GROUP BY 1""",
    "chunk_documents": r"""WITH f AS (SELECT 'docs/' || coalesce(lang, 'none') || '/doc_' || doc_id || '.md' AS path, string_split(regexp_replace(text, '\r\n|\r', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
      t AS (SELECT path, CASE WHEN l[-1] = '' THEN l[:len(l) - 1] ELSE l END AS l FROM f),
      w AS (SELECT path, l, unnest(range(0, 1 + greatest(0, CAST(ceil((len(l) - 40) / 35) AS BIGINT)))) AS k FROM t WHERE len(l) > 0)
      SELECT path, CAST(k * 35 + 1 AS INTEGER) AS start_line, CAST(least(k * 35 + 40, len(l)) AS INTEGER) AS end_line, md5(array_to_string(l[k * 35 + 1:k * 35 + 40], chr(10))) AS text_md5 FROM w""",
    "chunk_lines": r"""WITH p AS (SELECT path, start_line, end_line, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM chunks),
      q AS (SELECT path, start_line, end_line, CASE WHEN l[-1] = '' AND len(l) > end_line - start_line + 1 THEN l[:len(l) - 1] ELSE l END AS l FROM p),
      r AS (SELECT path, unnest(range(start_line, end_line + 1)) AS line, unnest(l) AS t FROM q WHERE len(l) = end_line - start_line + 1)
      SELECT path, count(*) AS n_lines, CAST(min(line) AS INTEGER) AS first_line, CAST(max(line) AS INTEGER) AS last_line, CAST(sum(length(t)) AS BIGINT) AS chars FROM r GROUP BY path""",
    "term_frequencies": _TF + " SELECT key AS chunk_id, term, tf, CAST(len AS INTEGER) AS len FROM tf",
    "document_frequencies": _TF + " SELECT term, count(*) AS df FROM tf GROUP BY term",
    "field_stats": f"SELECT 'content' AS field, count(*) AS n, CAST(sum(len({_TOK.format('text')})) AS BIGINT) AS total_len FROM chunks UNION ALL SELECT 'path', count(*), CAST(sum(len({_TOK.format('path')})) AS BIGINT) FROM chunks",
    "declared_symbols": f"WITH {_SYM} SELECT chunk_id, name, count(*) AS n FROM sym GROUP BY ALL",
    "reference_weights": f"WITH {_SYM}, {_WEIGHT} SELECT path, name, round(weight, 9) AS weight FROM wt",
    "question_terms": f"WITH {_QT} SELECT * FROM qt",
    "bm25_content": _TF + f", {_QT}, " + _SCORE.format("c", "tf", "toks") + " SELECT qid, chunk_id, round(score, 6) AS score FROM xc",
    "bm25_baseline": _TF + f", {_QT}, {_PATH}, " + _SCORE.format("c", "tf", "toks") + ", " + _SCORE.format("p", "ptf", "ptoks") + " SELECT qid, chunk_id, round(sum(s), 6) AS baseline FROM (SELECT qid, chunk_id, score AS s FROM xc UNION ALL SELECT qid, chunk_id, 0.3 * score FROM xp) GROUP BY ALL",
    "symbol_scores": f"WITH {_QT}, {_SYM}, {_WEIGHT}, nsym AS (SELECT *, row_number() OVER () AS o FROM sym), stoks AS (SELECT o AS key, {_TOK.format('name')} AS t FROM nsym), stf AS (SELECT key, term, count(*) AS tf, any_value(l) AS len FROM (SELECT key, len(t) AS l, unnest(t) AS term FROM stoks) GROUP BY key, term), "
    + _SCORE.format("s", "stf", "stoks") + " SELECT xs.qid, n.chunk_id, round(max(xs.score * w.weight), 6) AS score FROM xs JOIN nsym n ON n.o = xs.chunk_id JOIN wt w ON w.path = n.path AND w.name = n.name GROUP BY 1, 2",
    "rrf_fusion": f"""WITH {_GIVEN}, b AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, chunk_id) - 1 AS r FROM (SELECT c.qid, k.chunk_id, max(c.score) AS s FROM candidate_scores c JOIN chunks k USING (path, start_line, end_line) WHERE c.score IS NOT NULL GROUP BY ALL)),
      u AS (SELECT qid, chunk_id, rn - 1 AS r, 0 AS l FROM g UNION ALL SELECT qid, chunk_id, r, 1 FROM b),
      a AS (SELECT qid, chunk_id, sum(1 / (61 + r)) AS s, min(l * 1000 + r) AS t FROM u GROUP BY ALL),
      z AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY round(s, 12) DESC, t) AS rank, chunk_id FROM a) SELECT * FROM z WHERE rank <= 60""",
    "round_robin_merge": f"WITH {_GIVEN} SELECT q.workspace, g.qid, g.chunk_id, row_number() OVER (PARTITION BY q.workspace ORDER BY g.rn, g.qid) AS place FROM g JOIN questions q USING (qid)",
    "request_budget_cut": rf"""WITH {_GIVEN}, s AS (SELECT g.qid, g.chunk_id, g.rn, strlen(c.text) + len(regexp_extract_all(c.text, '[\\"\n\r\t\x08\f]')) + 5 * len(regexp_extract_all(c.text, '[\x00-\x07\x0b\x0e-\x1f]')) + 2 AS bytes FROM g JOIN chunks c USING (chunk_id)),
      t AS (SELECT *, sum(bytes) OVER (PARTITION BY qid ORDER BY rn) + 1000 AS total FROM s) SELECT qid, chunk_id, CAST(bytes AS INTEGER) AS bytes, CAST(total AS BIGINT) AS total FROM t WHERE total <= 48000""",
    "judged_results": "WITH c AS (SELECT qid, path, start_line, max(score) AS score FROM candidate_scores WHERE score IS NOT NULL GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path || ':' || lpad(CAST(start_line AS VARCHAR), 9, '0')) AS place FROM c) SELECT qid, path, start_line, place, score > 0.5 AND place <= 5 AS result FROM o",
    "recall_mrr": f"""WITH {_GIVEN}, {_GOLD}, j AS (SELECT d.qid, d.path, min(g.rn) AS rank FROM (SELECT DISTINCT qid, path FROM gold) d LEFT JOIN g ON g.qid = d.qid AND g.path = d.path GROUP BY ALL)
      SELECT qid, count(*) AS gold, round(count(*) FILTER (rank <= 5) / count(*), 9) AS recall_at_5, round(count(*) FILTER (rank <= 20) / count(*), 9) AS recall_at_20, round(coalesce(1 / min(rank), 0), 9) AS mrr FROM j GROUP BY qid""",
    "range_hits": f"""WITH {_GIVEN}, {_GOLD}, j AS (SELECT d.qid, g.rn, coalesce(g.start_line <= d.end_line AND d.start_line <= g.end_line, false) AS hit FROM gold d LEFT JOIN g ON g.qid = d.qid AND g.path = d.path)
      SELECT qid, coalesce(bool_or(hit AND rn = 1), false) AS top1, coalesce(bool_or(hit AND rn <= 5), false) AS top5 FROM j GROUP BY qid""",
    "accuracy_at_20": f"WITH {_GIVEN}, {_GOLD} SELECT d.qid, bool_and(EXISTS (SELECT 1 FROM g WHERE g.qid = d.qid AND g.path = d.path AND g.rn <= 20)) AS all_found FROM (SELECT DISTINCT qid, path FROM gold) d GROUP BY d.qid",
    "excerpt_coverage": f"""WITH {_GIVEN}, {_GOLD} SELECT CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.qid = d.qid AND g.path = d.path AND g.rn <= 5 AND g.start_line <= d.start_line AND d.end_line <= g.end_line) THEN 'covered'
      WHEN EXISTS (SELECT 1 FROM g WHERE g.qid = d.qid AND g.path = d.path) THEN 'listed' ELSE 'missed' END AS outcome, count(*) AS n FROM gold d GROUP BY 1""",
    "dev_split": "SELECT qid, CASE WHEN CAST('0x' || substr(sha256(CAST(qid AS VARCHAR)), 1, 2) AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'heldout' END AS split FROM questions",
}
