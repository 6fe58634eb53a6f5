"""What of a source text is code: import statements over several lines, and text with comments and strings blanked."""

from __future__ import annotations

import re

#: By extension: how an import opens, what on that line leaves it open, and what closes it again.
_SCRIPT = (r"import[ {]|export \{|export .* from |(?:const|let|var) .*require\(", r"^[^}]*\{[^}]*$", "}")
_PYTHON = (r"import |from .* import ", r"^[^)]*\([^)]*$", ")")
_RUST = (r"use |pub(?:\((?:crate|super)\))? use |extern crate ", r"[^;]$", ";")
_GO = (r"import[ (]|package ", r"\($", ")")
_JVM = (r"import |package ", None, None)
_RUBY = (r"require(?:_relative)?[ (]", None, None)
IMPORTS = {
    **dict.fromkeys(["js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"], _SCRIPT), **dict.fromkeys(["py", "pyi"], _PYTHON), "rs": _RUST, "go": _GO,
    **dict.fromkeys(["java", "kt", "kts", "scala"], _JVM), "rb": _RUBY,
}
#: An import that is still open after so many lines was none.
OPEN_LINES = 200


def import_lines(path: str, lines: list[str]) -> list[int]:
    """The places (from 0) of lines that import or declare dependencies, those of an import over several lines too."""
    rule = IMPORTS.get(path.rsplit(".", 1)[-1])
    if rule is None:
        return []
    opens, unclosed, close = re.compile(rule[0]), rule[1] and re.compile(rule[1]), rule[2]
    found, i = [], 0
    while i < len(lines):
        line = lines[i].strip()
        if opens.match(line):
            found.append(i)
            if unclosed and unclosed.search(line):
                end = next((j for j in range(i + 1, min(len(lines), i + 1 + OPEN_LINES)) if close in lines[j]), min(len(lines), i + 1 + OPEN_LINES) - 1)
                found += range(i + 1, end + 1)
                i = end
        i += 1
    return found


_QUOTED = r"\"(?:\\.|[^\"\\])*(?:\"|\Z)|'(?:\\.|[^'\\])*(?:'|\Z)|`(?:\\.|[^`\\])*(?:`|\Z)"
_IN_LINE = r"\"(?:\\.|[^\"\\\n])*(?:\"|$)|'(?:\\.|[^'\\\n])*(?:'|$)|`(?:\\.|[^`\\])*(?:`|\Z)"
_BLANKED = {
    "hash": re.compile(r"(?ms)#[^\n]*|'''.*?(?:'''|\Z)|\"\"\".*?(?:\"\"\"|\Z)|" + _IN_LINE),
    "rust": re.compile(r"(?ms)//[^\n]*|/\*|\br(#*)\".*?(?:\"\1|\Z)|'[A-Za-z_](?!')|" + _QUOTED),
    "braces": re.compile(r"(?ms)//[^\n]*|/\*|" + _QUOTED),
}
_NESTED = re.compile(r"/\*|\*/")
_FILLED = re.compile(r"[^\n\r]")


def blanked(path: str, text: str) -> str:
    """A text with its comments and strings turned into blanks; line ends, length and all code stay in place.

    Strings with code in them count as strings, so a name within one is no use of it. Block comments nest."""
    ext = path.rsplit(".", 1)[-1]
    style = "hash" if ext in ("py", "pyi", "rb") else "rust" if ext == "rs" else "braces"
    out, at = [], 0
    while m := _BLANKED[style].search(text, at):
        start, end = m.span()
        if m.group() == "/*":
            depth = 1
            while depth:
                n = _NESTED.search(text, end)
                if n is None:
                    end = len(text)
                    break
                depth += 1 if n.group() == "/*" else -1
                end = n.end()
        kept = style == "rust" and end - start == 2 and text[start] == "'"  # a lifetime
        out += [text[at:start], text[start:end] if kept else _FILLED.sub(" ", text[start:end])]
        at = max(end, start + 1)
    return "".join([*out, text[at:]])
