import json

import pytest
from pyspark.sql import functions as F

from ferrule.functions import questions as Q
from ferrule.functions import source
from ferrule.functions import text as X
from ferrule.operators import candidates, imports, lookup, usages
from ferrule.sources import snapshots

DEFS = "name string, qualified string, path string, start_line int, end_line int, exported boolean"


def _defs(spark):
    rows = [("handle", "Server.handle", "src/server.py", 3, 9, True), ("handle", "Client.handle", "src/client.py", 3, 9, True), ("handle", "handle", "tests/test_x.py", 1, 2, True), ("Parse", "Parse", "a.go", 1, 5, True)]
    rows += [("get", f"C{i}.get", f"src/f{i}.py", 1, 2, True) for i in range(6)]
    return spark.createDataFrame(rows, DEFS)


def test_lookup_levels_and_pins(spark):
    w = spark.createDataFrame([(1, "Server::handle", 0), (1, "parse", 1), (1, "nothing", 2), (1, None, 3), (2, "get", 0), (3, "get", 0), (4, "handle", 0)], "qid long, name string, order int")
    found = lookup.lookup(w, _defs(spark))
    got = {(r["qid"], r["name"], r["level"], r["path"]) for r in found.where("qid = 1").collect()}
    assert got == {(1, "Server::handle", 0, "src/server.py"), (1, "parse", 1, "a.go")}
    assert [tuple(r) for r in lookup.missing(w, found).collect()] == [(1, "nothing")]
    q = spark.createDataFrame([(1, "what does it do"), (2, "what is get"), (3, "what is get in f3.py"), (4, "where does Client handle it")], "qid long, question string")
    pins = {(r["qid"], r["path"], r["others"]) for r in lookup.pins(found, q).collect()}
    # A name of six definitions is pinned only with a hint; the container in the question decides between two.
    assert pins == {(1, "src/server.py", 0), (1, "a.go", 0), (3, "src/f3.py", 5), (4, "src/client.py", 2)}
    short = spark.createDataFrame([(1, 1, "a.go", 1, 5), (1, 2, "z.go", 1, 5)], "qid long, rank int, path string, start_line int, end_line int")
    listed = lookup.pinned_shortlist(lookup.pins(found, q).where("qid = 1"), short).orderBy("rank").collect()
    assert [(r["path"], r["pinned"]) for r in listed] == [("src/server.py", True), ("a.go", True), ("z.go", False)]


def test_candidates(spark):
    c = spark.createDataFrame([(1, "a", 1, 9, 0.9, False), (1, "a", 1, 9, 0.8, True), (1, "b", 1, 9, 0.9, True), (1, "c", 1, 9, 0.4, False), (1, "d", 1, 9, None, False), (1, "a", 5, 20, 0.3, False)], "qid long, path string, start_line int, end_line int, score double, connected boolean")
    m = candidates.merged(c)
    got = {(r["path"], r["start_line"]): (r["place"], r["score"]) for r in m.collect()}
    assert got[("a", 1)] == (1, 0.9) and got[("b", 1)][1] == pytest.approx(0.36) and got[("d", 1)] == (5, None)
    judged = m.withColumn("result", F.coalesce(F.col("score") > 0.5, F.lit(False)))
    assert {r["path"] for r in candidates.runners_up(judged).collect()} == {"b", "c"}
    assert {(r["path"], r["start_line"]) for r in candidates.others(judged, judged.where("result")).collect()} == {("b", 1), ("c", 1), ("d", 1)}
    assert candidates.changed_evidence(c, c.where("path <> 'd'")).count() == 1 and candidates.changed_evidence(c, c).count() == 0
    acts = spark.createDataFrame([(1, "x", 0.5), (1, "w", 0.7), (1, "v", 0.7), (2, "x", 0.4)], "qid long, action string, p double")
    stop = spark.createDataFrame([(1, 0.6), (2, 0.4)], "qid long, p double")
    assert {tuple(r) for r in candidates.chosen_actions(acts, stop).collect()} == {(1, "v"), (2, None)}
    with pytest.raises(Exception, match="probabilities"):
        candidates.chosen_actions(acts.withColumn("p", F.lit(1.5)), stop).collect()
    assert candidates.merged(c.limit(0)).count() == 0


def test_each_definition_is_judged(spark):
    d = spark.createDataFrame([("a.py", "helper", 1, 2, True), ("b.py", "helper", 1, 2, True), ("a.py", "_old", 4, 5, False), ("a.py", "probe", 7, 8, True), ("a.py", "run", 9, 9, True), ("a.py", "used", 10, 11, True)], "path string, name string, start_line int, end_line int, exported boolean")
    lines = [("a.py", 1, "def helper(x):"), ("b.py", 1, "def helper(y):"), ("a.py", 4, "def _old():"), ("a.py", 5, "    return _old"), ("a.py", 7, "def probe():"), ("tests/t.py", 1, "probe()"), ("a.py", 10, "def used():"), ("c.py", 3, "used()"), ("c.md", 1, "_old")]
    got = {(r["path"], r["name"]): r["bucket"] for r in usages.unused(d, spark.createDataFrame(lines, "path string, line int, line_text string")).collect()}
    # The two helpers are each other's use, by name.
    assert got == {("a.py", "_old"): "private", ("a.py", "probe"): "tests_only"}


@pytest.mark.parametrize(
    "path,text,lines",
    [
        ("a.py", "import os\nfrom x import (\n    a,\n    b,\n)\nx = 1\n", [0, 1, 2, 3, 4]),
        ("a.ts", "import {\n  A,\n} from './a';\nconst b = require('b');\nlet c = 1;", [0, 1, 2, 3]),
        ("a.rs", "use a::{\n  b,\n};\nfn f() {}", [0, 1, 2]),
        ("a.go", 'package a\nimport (\n  "x"\n)\nvar y = 1', [0, 1, 2, 3]),
        ("A.java", "package a;\nimport b.C;\nclass A {}", [0, 1]),
        ("a.rb", "require_relative 'b'\nx = 1", [0]),
        ("a.md", "import x", []),
    ],
)
def test_import_lines(path, text, lines):
    assert source.import_lines(path, text.split("\n")) == lines


@pytest.mark.parametrize(
    "path,text,code",
    [
        ("a.py", "x = 'y # z' # note\ns = \"\"\"a\nb\"\"\" + t", "x = " + " " * 14 + "\ns = " + " " * 4 + "\n" + " " * 4 + " + t"),
        ("a.js", "a(/* x /* y */ z */ 'q', `m\nn`) // e", "a(                     ,   \n  )     "),
        ("a.rs", "fn f<'a>(x: &'a str) { r#\"q\" q\"# }", "fn f<'a>(x: &'a str) { " + " " * 9 + " }"),
        ("a.c", 'p("\\"", 1); // "', "p(    , 1);     "),
        ("a.py", "'open\nx", "     \nx"),
    ],
)
def test_blanked(path, text, code):
    assert source.blanked(path, text) == code and len(code) == len(text)


def test_imports_to_definitions(spark):
    i = spark.createDataFrame([("src/a.ts", "./b", "B"), ("src/a.ts", "../lib", "L"), ("src/a.ts", "react", "R"), ("p/m/x.py", "..util", "go"), ("src/a.ts", "../../../b", "B"), ("src/a.ts", "./two", "T")], "path string, specifier string, name string")
    files = spark.createDataFrame([("src/b.ts",), ("lib/index.js",), ("p/util.py",), ("src/two.ts",)], "path string")
    got = {(r["specifier"]): r["module"] for r in imports.modules(i, files).collect()}
    assert got == {"./b": "src/b.ts", "../lib": "lib/index.js", "react": None, "..util": "p/util.py", "../../../b": None, "./two": "src/two.ts"}
    d = spark.createDataFrame([("B", "src/b.ts", 1, 3, True), ("L", "lib/index.js", 2, 4, False), ("go", "p/util.py", 5, 6, True), ("T", "src/two.ts", 1, 2, True), ("T", "src/two.ts", 3, 4, True)], "name string, path string, start_line int, end_line int, exported boolean")
    assert {(r["name"], r["module"], r["start_line"]) for r in imports.imported_definitions(i, files, d).collect()} == {("B", "src/b.ts", 1), ("go", "p/util.py", 5)}


def test_texts_cut_by_bytes(spark):
    rows = [(t,) for t in ("", "abc", "é" * 30, "漢" * 20, "😀" * 15, "a😀" * 12, 'q"\n' * 30, None, "  padded  ")]
    df = spark.createDataFrame(rows, "t string").select("t", X.byte_prefix("t", 17).alias("b"), X.json_prefix("t", 17).alias("j"), X.trimmed_row("t", 17).alias("r"))
    for r in df.collect():
        t = r["t"]
        if t is None:
            assert r["b"] is None and r["j"] is None and r["r"] is None
            continue
        best = max((t[:k] for k in range(len(t) + 1) if len(t[:k].encode()) <= 17), key=len)
        assert r["b"] == best
        assert r["j"] == max((t[:k] for k in range(len(t) + 1) if len(json.dumps(t[:k], ensure_ascii=False).encode()) - 2 <= 17), key=len)
        assert r["r"] == t.strip() if len(t.strip().encode()) <= 17 else r["r"].endswith("…")


def test_gate_and_paths(spark):
    rows = [("/help",), ("short one",), ("thanks",), ("sounds good",), ("keep it so",), ("run the linter and fix it all",), ("run `parse_it` and fix it all",), ("look at ./src/app/main.rs, please.",), ("where is the config of the parser read",)]
    got = spark.createDataFrame(rows, "q string").select("q", Q.gate_reason(F.col("q"), Q.code_names("q")).alias("r"), Q.path_tokens(F.col("q")).alias("p"), Q.code_shaped(F.col("q")).alias("c")).collect()
    assert [r["r"] for r in got] == ["command", "short", "short", "short", "short", "chore", None, None, None]
    assert got[7]["p"] == ["src/app/main.rs"] and got[8]["c"] and not got[5]["p"]


def test_small_files(spark, tmp_path):
    env = spark.createDataFrame([("A=1\nexport B='x y'\n# c\nC: \"z\"\nA=2 # late\nbad line\n",)], "t string").select(X.dotenv("t").alias("m")).first()["m"]
    assert env == {"A": "2", "B": "x y", "C": "z"}
    conf = '{ // c\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "//x,]"],},}, /* d */ "extends": "./b",}'
    got = spark.createDataFrame([(conf,), ("nope",), (None,)], "t string").select(snapshots.module_config("t").alias("c")).collect()
    assert got[0]["c"].asDict() == {"base_url": ".", "paths": {"@/*": ["src/*", "//x,]"]}, "extends": True} and got[1]["c"]["extends"] is None
    good = [{"id": "a", "text": "one", "other": 1}, {"id": "b", "text": "two", "source": "s"}]
    (tmp_path / "good.json").write_text(json.dumps(good))
    assert sorted(tuple(r) for r in snapshots.read_items(spark, str(tmp_path / "good.json")).collect()) == [("a", "one", None), ("b", "two", "s")]
    for bad in ([{"id": "a", "text": " "}], [{"id": "a", "text": "x"}] * 2, [{"id": "a", "text": "x", "source": 3}], [{"id": "x" * 201, "text": "y"}], {"id": 1}, [{"id": str(i), "text": "t"} for i in range(61)]):
        (tmp_path / "bad.json").write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            snapshots.read_items(spark, str(tmp_path / "bad.json"))
    one = spark.createDataFrame([(1, "x")], "n int, s string")
    assert snapshots.record_metrics(one, str(tmp_path / "m")) and not snapshots.record_metrics(one, "nosuch://there")
    gold = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, sha256 string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, digest string")
    assert {r["path"] for r in snapshots.stale_gold(gold, now).collect()} == {"b", "c"}


def test_snapshots(spark, tmp_path):
    folder, m = str(tmp_path / "snap"), spark.createDataFrame([("a", "1")], "path string, digest string")
    assert snapshots.read_snapshot(spark, folder, m) is None
    for n in (1, 2):
        snapshots.write_snapshot({"numbers": spark.range(n)}, m, folder)
        assert snapshots.read_snapshot(spark, folder, m)["numbers"].count() == n
    assert snapshots.read_snapshot(spark, folder, m.withColumn("digest", F.lit("2"))) is None
    snapshots.write_snapshot({"numbers": spark.range(1)}, m, folder, 7)
    assert snapshots.purge_snapshots(spark, folder) == ["v7"] and snapshots.read_snapshot(spark, folder, m) is not None
