"""Comment spans of a source text, for all languages, by one scan over strings and comments."""

from __future__ import annotations

import re

# How comments and strings are written. A string ends at its own delimiter.
SLASHES = {"javascript", "jsx", "typescript", "tsx", "go", "rust", "java", "c", "cpp"}
BACKTICKS = {"javascript", "jsx", "typescript", "tsx", "go"}
TOKEN = {
    "slash": re.compile(r"""//[^\n\r]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?|`(?:\\.|[^`\\])*+`?""", re.S),
    "rust": re.compile(r"""//[^\n\r]*|/\*|r(#*)".*?"\1|b?"(?:\\.|[^"\\])*+"?|'(?:\\.[^']*|[^'\\\n])'""", re.S),
    "hash": re.compile(r"""\#[^\n\r]*|^=begin\b.*?^=end[^\n\r]*|<<[~-]?(["']?)([A-Z_]\w*)\1[^\n]*\n.*?^[ \t]*\2\b|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?""", re.S | re.M),
}
REGEX_BEFORE = re.compile(r"(?:^|[=(,:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new))\s*$")
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def spans(code: str, language: str) -> list[tuple[int, int]]:
    """(start, end) of each comment."""
    if language == "python":
        return python_spans(code)
    kind = "rust" if language == "rust" else "slash" if language in SLASHES else "hash"
    pattern, out, at = TOKEN[kind], [], 0
    scripted = language in ("javascript", "jsx", "typescript", "tsx")
    while m := pattern.search(code, at):
        start, said, at = m.start(), m[0], m.end()
        if scripted and "/" in code[m.pos : start + 1]:
            # A regular expression in between may hold quotes or slashes.
            slash = code.find("/", m.pos)
            while 0 <= slash <= start:
                if REGEX_BEFORE.search(code, max(0, slash - 40), slash) and (r := REGEX.match(code, slash)):
                    break
                slash = code.find("/", slash + 1)
            else:
                r = None
            if 0 <= slash <= start and r and r.end() > start:
                at = r.end()
                continue
        if kind == "rust" and said == "/*":
            depth = 1
            for t in re.compile(r"/\*|\*/").finditer(code, at):
                depth += 1 if t[0] == "/*" else -1
                if not depth:
                    at = t.end()
                    break
            else:
                at = len(code)
            out.append((start, at))
        elif said[:2] in ("//", "/*") or said[0] == "#" or said.startswith("=begin"):
            if said[0] == "`" or language != "go" and said[0] == "`":
                continue
            out.append((start, at))
    return out


def python_spans(code: str) -> list[tuple[int, int]]:
    pattern = re.compile(r"""\#[^\n\r]*|[A-Za-z]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|"(?:\\.|[^"\\\n])*+"?|'(?:\\.|[^'\\\n])*+'?)""", re.S)
    return [(m.start(), m.end()) for m in pattern.finditer(code) if m[0][0] == "#"]


LINE = re.compile(r"\r\n|\n|\r")
# White space, as for the lines of a text.
WHITE = frozenset("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff")


def classify(code: str, language: str) -> list[str]:
    """Of each line: code, comment (all that is visible is in comments) or blank."""
    if not code:
        return []
    inside = bytearray(len(code))
    for a, b in spans(code, language):
        inside[a:b] = b"\1" * (b - a)
    out, at = [], 0
    edges = [(m.start(), m.end()) for m in LINE.finditer(code)] + [(len(code), len(code))]
    for end, after in edges:
        seen = [i for i in range(at, end) if code[i] not in WHITE]
        out.append("blank" if not seen else "comment" if all(inside[i] for i in seen) else "code")
        at = after
    return out
