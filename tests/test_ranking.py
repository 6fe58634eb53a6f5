import math

from pyspark.sql import functions as F

from ferrule.functions import text as X
from ferrule.functions.questions import asks_for_tests, gate_reason, names_in
from ferrule.functions.stem import porter
from ferrule.operators import evaluation, index, links, ranges, ranking, requests, symbols, usages
from ferrule.operators.chunking import chunk_plain
from ferrule.plans import lexical, relations

CHUNK = "chunk_id long, workspace string, path string, start_line int, end_line int, text string"


def chunks(spark, rows):
    return spark.createDataFrame([(i, "w", p, a, b, t) for i, (p, a, b, t) in enumerate(rows)], CHUNK)


def questions(spark, *texts):
    return spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "qid long, question string, workspace string")


def test_hand_calculated_bm25(spark):
    c = chunks(spark, [("quartz.md", 1, 1, "quartz quartz filler"), ("other.md", 1, 1, "filler")])
    got = ranking.scores(c, questions(spark, "quartz")).collect()
    want = math.log(2) * (2 * 2.2) / (2 + 1.2 * (0.25 + 0.75 * 1.5)) + 0.3 * math.log(2)
    assert len(got) == 1 and abs(got[0]["baseline"] - want) < 1e-9


def test_order_of_rows_and_terms_does_not_matter(spark):
    rows = [(f"d{i}.md", 1, 3, f"alpha beta {'gamma ' * (i % 4)}") for i in range(30)]
    q = questions(spark, "gamma alpha gamma")
    a = [tuple(r)[0:2] + (r["path"],) for r in ranking.shortlist(chunks(spark, rows), q, with_symbols=False).orderBy("rank").collect()]
    b = [tuple(r)[0:2] + (r["path"],) for r in ranking.shortlist(chunks(spark, rows[::-1]).repartition(7), questions(spark, "alpha gamma"), with_symbols=False).orderBy("rank").collect()]
    assert [x[2] for x in a] == [x[2] for x in b]


def test_shortlist_with_stems_and_scope(spark):
    c = chunks(spark, [("a.py", 1, 2, "def renaming():\n    pass"), ("b.md", 1, 1, "nothing here")])
    other = spark.createDataFrame([(9, "elsewhere", "c.py", 1, 2, "renames renaming rename")], CHUNK)
    got = ranking.shortlist(c.unionByName(other), questions(spark, "rename"), stemmed=True).collect()
    assert [r["chunk_id"] for r in got] == [0]


def test_overlaps_are_suppressed_from_half_of_the_shorter(spark):
    rows = [(0, 1, 1, "f", 1, 40), (0, 2, 2, "f", 36, 75), (0, 3, 3, "f", 21, 40), (0, 4, 4, "g", 21, 40)]
    got = ranking.suppress_overlaps(spark.createDataFrame(rows, "qid long, rn int, chunk_id long, path string, start_line int, end_line int")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 4]


def test_neighbours_outside_the_shortlist_are_lifted(spark, tmp_path):
    rows = [("lib/a.md", 10, 11, "quartz quartz quartz"), ("lib/a.md", 12, 40, "quartz " + "filler " * 60), ("lib/a.md", 11, 12, "quartz " + "filler " * 50), ("lib/a.md", 1, 9, "nothing " * 9)]
    rows += [(f"d{i}.md", 1, 1, "quartz one") for i in range(70)]
    folder = stored(spark, tmp_path, rows)
    questions(spark, "quartz").write.parquet(f"{tmp_path}/questions.parquet")
    got = [tuple(r) for r in lexical.shortlist_neighbours(spark, folder).collect()]
    assert got == [(0, 1, 1)]
    ranked = {r["rank"]: r["chunk_id"] for r in ranking.shortlist(chunks(spark, rows), questions(spark, "quartz")).collect()}
    assert sorted(ranked) == list(range(1, 61)) and ranked[1] == 0 and ranked[60] == 1
    short = {r["rank"]: r["chunk_id"] for r in ranking.shortlist(chunks(spark, rows[:2]), questions(spark, "quartz")).collect()}
    assert short == {1: 0, 2: 1}


def test_reference_weight(spark):
    c = chunks(spark, [("lib.py", 1, 2, "def target_name():\n    pass"), ("a.py", 1, 1, "target_name()"), ("notes.md", 1, 1, "target_name")])
    got = index.reference_weights(index.symbols(c), index.identifiers(c)).collect()
    assert [(r["name"], round(r["weight"], 9)) for r in got] == [("target_name", round(1 + math.log(2), 9))]


def test_chunks_of_plain_text(spark):
    rows = [("a", "\n".join(map(str, range(1, 77)))), ("b", ""), ("c", None), ("d", "x\r\ny\r"), ("e", "z")]
    got = chunk_plain(spark.createDataFrame(rows, "path string, text string")).orderBy("path", "start_line").collect()
    assert [(r["path"], r["start_line"], r["end_line"]) for r in got] == [("a", 1, 40), ("a", 36, 75), ("a", 71, 76), ("d", 1, 2), ("e", 1, 1)]


def test_stems():
    pairs = "renaming renam atomically atom atomic atom ponies poni caresses caress relational relat yelling yell filing file sky sky ties ti ied i".split()
    assert [porter(w) for w in pairs[::2]] == pairs[1::2]


def test_questions(spark):
    q = spark.createDataFrame([("which tests cover this",), ("Do not locate or change tests",), (None,)], "q string")
    assert [r[0] for r in q.select(asks_for_tests("q")).collect()] == [True, False, None]
    assert names_in("Where does `frob` call foo_bar and Upload.create in main.py?") == ["frob", "foo_bar", "Upload.create"]
    p = spark.createDataFrame([("/help me please",), ("ok",), ("go ahead please",), ("commit all of it now",), ("where is the cache filled?",)], "p string")
    assert [r[0] for r in p.select(gate_reason(F.col("p"))).collect()] == ["command", "short", "few words", "chore", None]


def test_usages_and_unused(spark):
    lines = [("a.py", 1, "def helper_one():"), ("a.py", 2, "    return 1"), ("b.py", 1, "x = helper_one()"), ("b.py", 2, "# helper_one is fine"), ("tests/test_a.py", 1, "helper_two()"), ("a.py", 5, "def helper_two():"), ("n.md", 1, "helper_one")]
    df = spark.createDataFrame(lines, "path string, line int, line_text string")
    names = spark.createDataFrame([("helper_one",), ("helper_two",)], "name string")
    uses = usages.word_uses(df, names)
    kinds = {(r["path"], r["line"]): r["kind"] for r in uses.collect()}
    assert kinds[("b.py", 1)] == "call" and kinds[("b.py", 2)] == "mention"
    defs = spark.createDataFrame([("a.py", "helper_one", 1, 2), ("a.py", "helper_two", 5, 5)], "path string, name string, start_line int, end_line int")
    assert [tuple(r) for r in usages.unused(defs, df).collect()] == [("a.py", "helper_two", 5, "tests_only")]


def stored(spark, tmp_path, rows):
    chunks(spark, rows).write.parquet(f"{tmp_path}/chunks.parquet")
    return str(tmp_path)


def test_short_names_have_tests_and_definitions(spark, tmp_path):
    folder = stored(spark, tmp_path, [("src/a.py", 1, 2, "def run():\n    return 1"), ("src/b.py", 1, 2, "def start():\n    return run()"), ("tests/test_b.py", 1, 1, "run()")])
    assert {(r["name"], r["path"]) for r in relations.tests_for(spark, folder).collect()} >= {("run", "tests/test_b.py")}
    assert {(r["path"], r["line"]): r["name"] for r in relations.enclosing_definition(spark, folder).collect()} == {("src/a.py", 1): "run", ("src/b.py", 1): "start", ("src/b.py", 2): "start", ("tests/test_b.py", 1): None}


def test_tests_named_after_a_file_count_without_a_use(spark):
    uses = spark.createDataFrame([("t/x_test.py", 3, "probe_one()", "probe_one"), ("t/x_test.py", 4, "probe_one()", "probe_one"), ("tests/test_probe.py", 7, "probe_two()", "probe_two")], "path string, line int, line_text string, name string")
    declared = spark.createDataFrame([("probe_one", "src/probe.py"), ("probe_two", "src/probe.py"), ("probe_one", "tests/test_probe.py")], "name string, path string")
    paths = spark.createDataFrame([("src/probe.py",), ("tests/test_probe.py",), ("src/probe.test.ts",), ("t/x_test.py",), ("src/probe_user.py",)], "path string")
    got = sorted((r["defined_in"], r["name"], r["rank"], r["path"], r["uses"], r["line"], r["confidence"]) for r in usages.tests_for(uses, declared, paths).collect())
    assert got == [
        ("src/probe.py", "probe_one", 1, "src/probe.test.ts", 0, None, "high"),
        ("src/probe.py", "probe_one", 2, "tests/test_probe.py", 0, None, "high"),
        ("src/probe.py", "probe_one", 3, "t/x_test.py", 2, 3, "medium"),
        ("src/probe.py", "probe_two", 1, "tests/test_probe.py", 1, 7, "high"),
        ("src/probe.py", "probe_two", 2, "src/probe.test.ts", 0, None, "high"),
        ("tests/test_probe.py", "probe_one", 1, "t/x_test.py", 2, 3, "medium"),
    ]


def test_definitions_run_past_their_chunk(spark, tmp_path):
    rows = [("a.py", 1, 3, "class Holder:\n    def first(self):\n        return 1\n"), ("a.py", 4, 5, "    def second_one(self):\n        return self.second_one()"), ("a.py", 5, 6, "        return self.second_one()\n        # end"), ("a.py", 9, 9, "    def apart(self): pass"), ("b.go", 1, 2, "func Long(x int) {\n  y()"), ("b.go", 3, 4, "  Long(1)\n}")]
    folder = stored(spark, tmp_path, rows)
    got = {(r["path"], r["qualified"], r["kind"], r["start_line"], r["end_line"]) for r in relations.definitions(spark, folder).collect()}
    assert got == {("a.py", "Holder", "class", 1, 5), ("a.py", "Holder.first", "method", 2, 3), ("a.py", "Holder.second_one", "method", 4, 5), ("a.py", "apart", "function", 9, 9), ("b.go", "Long", "function", 1, 4)}
    assert {r["name"] for r in relations.unused_definitions(spark, folder).collect()} >= {"Long", "second_one"}


def test_definitions(spark):
    src = "class A:\n    @wrap\n    def run(self):\n        return 1\n"
    rows = [("a.py", src), ("b.go", "func Go(x int) {\n  y()\n}\n"), ("c.py", "def broken(:\n"), ("d.py", None)]
    got = {(r["path"], r["qualified"], r["start_line"], r["end_line"], r["detection"]) for r in symbols.definitions(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert ("a.py", "A.run", 2, 4, "parsed") in got and ("b.go", "Go", 1, 3, "lexical") in got and any(p == "c.py" for p, *_ in got)


def test_ranges(spark):
    spans = spark.createDataFrame([("f", "outer", 1, 200), ("f", "inner", 60, 70)], "path string, name string, start_line int, end_line int")
    points = spark.createDataFrame([("f", 65), ("f", 150), ("g", 1)], "path string, line int")
    assert {(r["path"], r["line"]): r["name"] for r in ranges.enclosing(points, spans).collect()} == {("f", 65): "inner", ("f", 150): "outer", ("g", 1): None}
    merged = ranges.merged(spark.createDataFrame([("f", 1, 5), ("f", 6, 9), ("f", 20, 30), ("f", 22, 25)], "path string, start_line int, end_line int"), ["path"])
    assert sorted((r["start_line"], r["end_line"], r["parts"]) for r in merged.collect()) == [(1, 9, 2), (20, 30, 2)]


def test_connected_pairs(spark):
    c = chunks(spark, [("src/cache.py", 1, 1, "def fill_cache(): pass"), ("tests/test_cache.py", 1, 1, "fill_cache()"), ("lib/user.py", 1, 1, "fill_cache()")])
    seeds = spark.createDataFrame([(0, "src/cache.py", 1, 1.0)], "qid long, path string, seed int, weight double")
    got = [r["path"] for r in links.connected(c, seeds).orderBy("rank").collect()]
    assert got == ["tests/test_cache.py", "lib/user.py"]


def test_judging_and_evaluation(spark):
    j = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.7), (0, 2, 0.7)], "qid long, i int, score double")
    got = requests.judged_order(j, "qid", "score", "i").orderBy("place").collect()
    assert [(r["i"], r["result"]) for r in got] == [(1, True), (2, True), (0, False)]
    ranked = spark.createDataFrame([(0, "x", 1), (0, "y", 7)], "qid long, item string, rank int")
    gold = spark.createDataFrame([(0, "y"), (0, "z"), (1, "x")], "qid long, item string")
    r = {x["qid"]: x for x in evaluation.recall_mrr(ranked, gold).collect()}
    assert (r[0]["recall_at_5"], r[0]["recall_at_20"], r[0]["mrr"], r[1]["mrr"]) == (0.0, 0.5, 1 / 7, 0.0)


def test_text_functions(spark):
    df = spark.createDataFrame([("HTTPServer fooBar",)], "t string")
    row = df.select(X.tokens("t"), X.underscore(F.lit("HTTPServerName")), X.area_of(F.lit("a/b/c.py")), X.file_stem(F.lit("x/test_foo.py")), X.short_count(F.lit(1_234_567)), X.camelize(F.lit("foo_bar"))).first()
    assert list(row) == [["http", "server", "foo", "bar"], "http_server_name", "a/b", "foo", "1.2M", "FooBar"]


def test_scorer_rejects_bad_answers(spark):
    df = spark.createDataFrame([("a b", "a")], "question string, text string")
    assert requests.score_with(df, requests.word_overlap).first()["score"] == 0.5
    try:
        requests.score_with(df, lambda b: b["text"].map(len) + 5).collect()
    except Exception as e:
        assert "between 0 and 1" in str(e)
    else:
        raise AssertionError("a score above 1 passed")


def test_pairs_of_questions_and_chunks_are_not_shuffled(spark, tmp_path):
    folder = stored(spark, tmp_path, [("quartz.md", 1, 1, "quartz quartz filler"), ("other.md", 1, 1, "filler")])
    questions(spark, "quartz", "filler quartz", "nothing").write.parquet(f"{tmp_path}/questions.parquet")
    got = lexical.bm25_baseline(spark, folder)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[:2] for r in got.collect()) == [(0, 0), (1, 0), (1, 1)]


def test_scores_do_not_depend_on_blocks(spark, monkeypatch):
    rows = [(f"lib/{w}.md", 1, 1, f"alpha {w} {'gamma ' * (i % 4)}") for i, w in enumerate("quartz Beta delta HTTPServer alpha".split() * 3)] + [("none.md", 1, 1, None), ("empty", 1, 1, "")]
    c, q = chunks(spark, rows), questions(spark, "alpha beta gamma", "where is the server", None, "nothing", "md lib", "alpha " + " ".join(f"w{i}" for i in range(9)))
    want = {(r["qid"], r["chunk_id"]): round(r["baseline"], 9) for r in ranking.scores(c, q, with_symbols=False).collect()}
    assert len(want) > 30
    terms = ranking.question_terms(q)
    for asked, cells in ((200_000, 400_000), (7, 3), (16, 40)):  # all at once; words and questions in blocks; questions in blocks
        monkeypatch.setattr(ranking, "ASKED", asked)
        monkeypatch.setattr(ranking, "CELLS", cells)
        got = ranking.baseline(c, terms.unionByName(terms)).collect()  # a term that is asked twice counts once
        assert {(r["qid"], r["key"]): round(r["score"], 9) for r in got} == want and len(got) == len(want)
    assert ranking.baseline(c, terms.where("false")).count() == 0
    got = ranking.baseline(c, terms, ("q", "c", "s"), 3).collect()
    assert {(r["q"], r["c"]) for r in got} == set(want) and all(abs(r["s"] - want[r["q"], r["c"]]) < 0.00051 and r["s"] == round(r["s"], 3) for r in got)


def test_chunks_of_one_id_and_without_id_are_summed(spark):
    rows = [(7, "w", "a.md", 1, 1, "quartz filler"), (7, "w", "b.md", 1, 1, "quartz quartz"), (None, "w", "c.md", 1, 1, "quartz"), (None, "w", "d.md", 1, 1, "quartz"), (8, "w", "e.md", 1, 1, "quartz x")]
    c, q = spark.createDataFrame(rows, CHUNK), questions(spark, "quartz", "md")
    want = {(r["qid"], r["chunk_id"]): round(r["baseline"], 9) for r in ranking.scores(c, q, with_symbols=False).collect()}
    got = ranking.baseline(c, ranking.question_terms(q)).collect()
    assert len(got) == 6 and {(r["qid"], r["key"]): round(r["score"], 9) for r in got} == want
    got = ranking.baseline(c, ranking.question_terms(q), digits=3).collect()
    assert {(r["qid"], r["key"]): r["score"] for r in got} == {k: round(v, 3) for k, v in want.items()}


def test_content_pairs_are_not_shuffled(spark, tmp_path):
    folder = stored(spark, tmp_path, [("quartz.md", 1, 1, "quartz quartz filler"), ("quartz2.md", 1, 1, "filler")])
    questions(spark, "quartz", "filler quartz", "nothing").write.parquet(f"{tmp_path}/questions.parquet")
    got = lexical.bm25_content(spark, folder)
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    got = {(r["qid"], r["chunk_id"]): r["score"] for r in got.collect()}
    want = round(math.log(2) * (2 * 2.2) / (2 + 1.2 * (0.25 + 0.75 * 1.5)), 6)
    assert sorted(got) == [(0, 0), (1, 0), (1, 1)] and got[0, 0] == want  # paths have no part in it
