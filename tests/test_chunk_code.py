from ferrule.functions.inflect import pluralize, singularize
from ferrule.operators.chunking import chunk_code


def test_sections_begin_at_declarations(spark):
    src = "import x\n\n# says what\n# it does\ndef one():\n    pass\n\ndef two():\n    pass\n"
    long = "def big():\n" + "    step()\n" * 149
    rows = [("a.py", src), ("b.py", long), ("c.md", src), ("d.py", None), ("e.py", "")]
    got = sorted((r["path"], r["start_line"], r["end_line"]) for r in chunk_code(spark.createDataFrame(rows, "path string, text string")).collect())
    assert got == [("a.py", 1, 2), ("a.py", 3, 7), ("a.py", 8, 9), ("b.py", 1, 120), ("b.py", 116, 150), ("c.md", 1, 9)]


def test_inflections():
    for one, many in (("upload", "uploads"), ("category", "categories"), ("person", "people"), ("box", "boxes"), ("series", "series"), ("mouse", "mice"), ("child", "children")):
        assert (pluralize(one), singularize(many)) == (many, one)
