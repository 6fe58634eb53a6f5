"""Definitions, imports and calls of source files: Python by its own parser, other languages by their lines."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DEF = re.compile(
    r"^(?P<i>[ \t]*)(?:(?:pub(?:\([^)]*\))?|async|unsafe|const|export|default|public|private|protected|static|final|override|abstract|internal|open|sealed)\s+)*"
    r"(?P<k>fn|function\*?|def|fun|func|class|struct|enum|interface|trait|module|impl|type)\s+(?:\([^)\n]*\)\s*)?(?P<n>[A-Za-z_]\w*)"
)
_KIND = {"class": "class", "struct": "class", "interface": "class", "trait": "class", "enum": "class", "module": "module", "impl": "class", "type": "type"}
SCHEMA = "path string, name string, qualified string, kind string, start_line int, end_line int, detection string, exported boolean"


def python_definitions(text: str) -> list[tuple[str, str, str, int, int]] | None:
    """(name, qualified, kind, first line with decorators, last line), or None where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    out, stack = [], [(tree, "", False)]
    while stack:
        node, prefix, in_class = stack.pop()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                cls = isinstance(child, ast.ClassDef)
                qualified = f"{prefix}{child.name}"
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                out.append((child.name, qualified, "class" if cls else "method" if in_class else "function", first, child.end_lineno))
                stack.append((child, qualified + ".", cls))
            else:
                stack.append((child, prefix, in_class))
    return sorted(out, key=lambda d: (d[3], -d[4]))


def lexical_definitions(text: str) -> list[tuple[str, str, str, int, int]]:
    """The same by lines: a body ends with its closing brace or `end`, else before the next line that is not
    indented more."""
    lines = re.split(r"\r\n|\r|\n", text)
    lines = lines if lines[-1] else lines[:-1]
    braces = [line.count("{") - line.count("}") for line in lines]
    opens = ["{" in line for line in lines]
    # The indents of lines; a blank one ends nothing.
    indents = [len(line) - len(line.lstrip()) if line.strip() else len(text) for line in lines]
    out = []
    for i, line in enumerate(lines):
        m = _DEF.match(line)
        if not m:
            continue
        depth, end, opened = 0, i, False
        indent = len(m["i"])
        for j in range(i, len(lines)):
            depth += braces[j]
            opened = opened or opens[j]
            if opened and depth <= 0 or not opened and j > i and indents[j] <= indent:
                end = j if opened or lines[j].strip().startswith("end") else j - 1
                break
            end = j
        out.append((m["n"], m["n"], _KIND.get(m["k"], "function"), i + 1, end + 1))
    return out


def exported(path: str, name: str, line: str) -> bool:
    """Whether a definition can be used from outside its file, by its language's rule."""
    ext = path.rsplit(".", 1)[-1]
    if ext == "go":
        return name[:1].isupper()
    if ext in ("py", "pyi", "rb"):
        return not name.startswith("_")
    return re.match(r"\s*(?:pub\b|export\b|public\b|open\b)", line) is not None


def definitions(files: DataFrame, path: str = "path", text: str = "text", start_line: str | None = None) -> DataFrame:
    """path, name, qualified, kind, start_line, end_line, detection (parsed or lexical), exported of each
    definition.

    Null and empty texts have none; a file that does not parse is read by its lines. `start_line` shifts the
    lines of chunks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, t, s in zip(batch["p"], batch["t"], batch["s"]):
                found = python_definitions(t) if p.endswith((".py", ".pyi")) else None
                how = "lexical" if found is None else "parsed"
                lines = re.split(r"\r\n|\r|\n", t)
                for name, qualified, kind, a, b in lexical_definitions(t) if found is None else found:
                    rows.append((p, name, qualified, kind, a + s - 1, b + s - 1, how, exported(p, name, lines[a - 1])))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    s = F.coalesce(F.col(start_line).cast("int"), F.lit(1)) if start_line else F.lit(1)
    src = files.where(F.col(path).isNotNull() & F.col(text).isNotNull()).select(F.col(path).alias("p"), F.col(text).alias("t"), s.alias("s"))
    return src.mapInPandas(run, SCHEMA)


def imports(lines: DataFrame) -> DataFrame:
    """path, line, specifier of import lines (path, line, line_text), in the common forms."""
    forms = [r"^\s*from\s+([\w.]+)\s+import\b", r"^\s*import\s+[^'\"\n]*from\s+['\"]([^'\"]+)", r"^\s*import\s+['\"]([^'\"]+)", r"^\s*import\s+(?:static\s+)?([\w.]+)", r"require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)", r"^\s*use\s+([\w:]+)", r"^\s*#include\s*[<\"]([^>\"]+)", r"^\s*using\s+([\w.]+)\s*;"]
    found = F.coalesce(*[F.nullif(F.regexp_extract("line_text", p, 1), F.lit("")) for p in forms])
    return lines.select("path", "line", found.alias("specifier")).where("specifier IS NOT NULL")
