"""Column functions on texts and paths; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns that decide results.
STOP_WORDS = "a an and are by do does for how in is it its of on or the this that to what when where which who why".split()
CODE_PATH = r"\.(?:rs|[cm]?js|jsx|ts|tsx|py|go|java|cs|c|h|cc|cpp|hpp|rb|php|swift|kt)$"
TYPED_PATH = r"\.(?:java|cs|c|h|cc|cpp|hpp)$"
TEST_PATH = r"(?i)(?:^|/)(?:tests?|__tests__|spec|specs|testdata|fixtures)/|(?:^|/)test_[^/]*\.(?:py|pyi|rb|php|js|jsx|ts|tsx|mjs|cjs|rs|ex|exs)$|[._-](?:test|tests|spec)\.[a-z0-9]+$|_test\.[a-z0-9]+$|(?-i:(?:^|/)(?:Test[A-Z][^/]*|[^/]+Tests?)\.(?:java|kt|kts|scala|cs)$)"
DOCS_EXTENSIONS = "md mdx markdown rst txt adoc asciidoc html htm".split()
DATA_EXTENSIONS = "yml yaml json xml csv toml lock rake sql txt svg po pot".split()
HASH_COMMENTS = "py pyi rb rake gemspec sh bash zsh yml yaml toml pl r ex exs cr nim tf".split()
DASH_COMMENTS = "sql lua hs elm".split()
MARKUP_COMMENTS = "html htm xml vue svelte md erb".split()
IMPORT_LINE = r"^\s*(?:import\b|from\s+\S+\s+import\b|use\s+[A-Za-z_:]|require\s*\(|require\s+'|include\s+[A-Z]|extend\s+[A-Z]|using\s+|#include\b|export\s+\{|export\s+\*)"
TEST_ANCHOR = r"^\s*(?:(?:RSpec\.)?(?:describe|context)\b|describe\s*\(|class\s+\w|func\s+Test|def\s+test|test\s*\(|it\s*\()"
CLIENTS = ["claude", "codex", "opencode", "pi", "cursor"]
LANGUAGES = {
    "JavaScript": ["js", "jsx", "mjs", "cjs"], "TypeScript": ["ts", "mts", "cts"], "Tsx": ["tsx"], "Python": ["py", "pyi"], "Go": ["go"], "Rust": ["rs"],
    "Ruby": ["rb", "rake", "gemspec"], "Java": ["java"], "Kotlin": ["kt", "kts"],
}
SKIPPED = "where what which does do is are the a an to in of and or for with from when while other it its how be by".split()
DOTENV = r"^\s*(?:export\s+)?([A-Za-z0-9_.-]+)(?:\s*=\s*?|:\s+?)(\s*'(?:\\'|[^'])*'|\s*\"(?:\\\"|[^\"])*\"|\s*`(?:\\`|[^`])*`|[^#\r\n]+)?\s*(?:#[^\n]*)?$"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    """ARRAY<STRING>: camel case split, lower case, runs of ASCII letters and digits; null for null."""
    spaced = F.regexp_replace(F.regexp_replace(_c(text), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_extract_all(F.lower(spaced), F.lit("[a-z0-9]+"), 0)


def query_terms(text: str | Column) -> Column:
    """The distinct tokens of a question without stop words."""
    return F.array_except(F.array_distinct(tokens(text)), F.array(*[F.lit(w) for w in STOP_WORDS]))


def extension(path: str | Column) -> Column:
    """Lower-case part after the last dot; the whole path if there is none."""
    return F.lower(F.substring_index(_c(path), ".", -1))


def is_code_path(path: str | Column) -> Column:
    return _c(path).rlike(CODE_PATH)


def is_test_path(path: str | Column) -> Column:
    return _c(path).rlike(TEST_PATH)


def is_docs_path(path: str | Column) -> Column:
    return extension(path).isin(DOCS_EXTENSIONS)


def is_data_path(path: str | Column) -> Column:
    low = F.lower(_c(path))
    return extension(path).isin(DATA_EXTENSIONS) | low.rlike(r"^(scripts?|db)/|/(fixtures|locales|locale|generated)/|\.min\.js$")


def is_comment(path: str | Column, line: str | Column) -> Column:
    """Whether a whole line is a comment, by the file's extension."""
    x, ext = F.ltrim(_c(line)), extension(path)
    c_style = x.startswith("//") | x.startswith("/*") | (x == "*") | x.startswith("* ") | x.startswith("*/")
    php = (x.startswith("#") & ~x.startswith("#[")) | c_style
    return F.when(ext.isin(HASH_COMMENTS), x.startswith("#")).when(ext.isin(DASH_COMMENTS), x.startswith("--")).when(ext.isin(MARKUP_COMMENTS), x.startswith("<!--")).when(ext == "php", php).otherwise(c_style)


def area_of(path: str | Column) -> Column:
    """The first two folders of a path, one if there is one, a dot for a bare file."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) <= 1, F.lit(".")).when(F.size(parts) == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def file_stem(path: str | Column) -> Column:
    """Base name up to the first dot, lower case, without the marks of a test."""
    base = F.substring_index(F.lower(F.substring_index(_c(path), "/", -1)), ".", 1)
    base = F.regexp_replace(base, "^test_", "")
    return F.regexp_replace(F.regexp_replace(base, "(_test|_tests|_spec|test|tests|spec)$", ""), "^[-_]+|[-_]+$", "")


def leaf_of(name: str | Column) -> Column:
    """The last segment after a dot, a hash sign or a colon."""
    return F.element_at(F.split(_c(name), "[.#:]"), -1)


def utf16_length(text: str | Column) -> Column:
    return (F.octet_length(F.encode(_c(text), "UTF-16BE")) / 2).cast("int")


def utf16_order(text: str | Column) -> Column:
    """A sort key in the order of UTF-16 code units."""
    return F.encode(_c(text), "UTF-16BE")


def escaped_length(text: str | Column) -> Column:
    """Bytes of a text within a JSON string: two for quotes, backslashes and the short escapes, six for other
    control characters, else UTF-8."""
    t = _c(text)
    return F.octet_length(t) + F.regexp_count(t, F.lit('[\\\\"\\n\\r\\t\\x08\\f]')) + F.lit(5) * F.regexp_count(t, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))


def snippet(text: str | Column, lines: int = 8) -> Column:
    parts = F.split(_c(text), "\n", -1)
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n…"))).otherwise(_c(text))


def underscore(name: str | Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(_c(name), r"([A-Z\d]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(x, "-", "_"))


def camelize(name: str | Column) -> Column:
    return F.array_join(F.transform(F.split(_c(name), "_"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.expr("''"), F.substr(p, F.lit(2)))), "")


def short_count(n: str | Column) -> Column:
    """12k, 1.2M; small numbers as they are."""
    n = _c(n).cast("double")
    return F.when(n >= 1e6, F.concat(F.format_string("%.1f", n / 1e6), F.lit("M"))).when(n >= 1e3, F.concat(F.format_string("%.0f", n / 1e3), F.lit("k"))).otherwise(F.format_string("%.0f", n))


def byte_prefix(text: str | Column, most: int) -> Column:
    """The longest prefix of at most `most` bytes in UTF-8 that cuts no character."""
    raw = F.encode(_c(text), "UTF-8")
    inner = lambda i: F.hex(F.substring(raw, i, 1)).between("80", "BF")  # noqa: E731  a byte within a character
    back = F.when(inner(most - 1), 3).otherwise(2)
    end = F.when(~inner(most + 1), most).otherwise(most - F.when(~inner(most), 1).otherwise(back))
    return F.when(F.octet_length(_c(text)) <= most, _c(text)).otherwise(F.decode(F.substring(raw, F.lit(1), end.cast("int")), "UTF-8"))


def trimmed_row(text: str | Column, most: int = 120) -> Column:
    """A row of a listing: without blanks around it, cut at `most` bytes with an ellipsis."""
    t = F.regexp_replace(_c(text), r"(?U)^\s+|\s+\z", "")
    return F.when(F.octet_length(t) <= most, t).otherwise(F.concat(byte_prefix(t, most), F.lit("…")))


def json_prefix(text: str | Column, most: int) -> Column:
    """The longest prefix that takes at most `most` bytes within a JSON string."""
    chars = F.split(F.substring(_c(text), 1, most), "")  # a character takes a byte at least
    step = lambda a, c: F.struct((a["n"] + escaped_length(c)).alias("n"), F.when(a["n"] + escaped_length(c) <= most, a["k"] + 1).otherwise(a["k"]).cast("int").alias("k"))
    k = F.aggregate(F.filter(chars, lambda c: c != ""), F.struct(F.lit(0).cast("int").alias("n"), F.lit(0).cast("int").alias("k")), step, lambda a: a["k"])
    return F.substring(_c(text), F.lit(1), k)


def thousands(n: str | Column) -> Column:
    """1,234."""
    return F.format_number(_c(n), 0)


def client_of(session: str | Column) -> Column:
    """STRUCT<client, session> of `client:id`; an unknown client is none, and the whole value the session."""
    known = F.substring_index(_c(session), ":", 1).isin(CLIENTS) & F.contains(_c(session), F.lit(":"))
    rest = F.regexp_replace(_c(session), "^[^:]*:", "")
    return F.struct(F.when(known, F.substring_index(_c(session), ":", 1)).otherwise("").alias("client"), F.when(known, rest).otherwise(_c(session)).alias("session"))


def language_of(path: str | Column) -> Column:
    """The language that a parser reads a file as, by its extension; null for others."""
    ext = F.substring_index(_c(path), ".", -1)
    out = None
    for name, extensions in LANGUAGES.items():
        out = F.when(ext.isin(extensions), name) if out is None else out.when(ext.isin(extensions), name)
    return out


def expansions(question: str | Column) -> Column:
    """The question, its neighbouring pairs of content words, and these words, up to 16 of them."""
    words = F.slice(F.array_distinct(F.filter(tokens(question), lambda t: (F.length(t) > 2) & ~t.isin(SKIPPED))), 1, 16)
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(_c(question)), pairs, words)


def dotenv(text: str | Column) -> Column:
    """MAP of the KEY=value lines of a text, quotes taken off; of a repeated key the last counts."""
    lines = F.filter(F.split(F.regexp_replace(_c(text), "\r\n?", "\n"), "\n"), lambda x: x.rlike(DOTENV))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, DOTENV, 2)), r"^(['\"`])(.*)\1$", "$2")
    entries = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, DOTENV, 1).alias("k"), value(x).alias("v")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["k"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["k"] == k), -1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def usage_kind(path: str | Column, line: str | Column, called: str | Column) -> Column:
    """mention, import, call or reference: how a line uses a name that it calls or not."""
    return F.when(is_comment(path, line), "mention").when(_c(line).rlike(IMPORT_LINE), "import").when(_c(called), "call").otherwise("reference")
