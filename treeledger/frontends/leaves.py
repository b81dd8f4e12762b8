"""Leaves of the languages without a full frontend: operators and operands by one scan over tokens.

The scan knows no grammar; where a sign means different things by its place, the neighbouring tokens decide.
"""

from __future__ import annotations

import re

from treeledger.frontends import comments

# Signs and words that count as operators, longest signs first.
SIGNS = ">>>= === !== >>> **= <<= >>= &&= ||= ??= ..= ->* <=> ... &^= == != <= >= && || ?? ?. ++ -- << >> ** += -= *= /= %= &= |= ^= := => -> :: <- .. &. =~ !~ &^ .* + - * / % = < > ! ~ & | ^ ? .".split()
OPERATOR_WORDS = frozenset("sizeof alignof defined? as bitand bitor xor compl and_eq or_eq xor_eq not_eq and or not in is instanceof typeof new delete return throw raise yield await co_await co_yield co_return break continue".split())
NOT_IN = {
    "javascript": "?: .. ..= -> :: <- <=> =~ !~ &^ &^= &. .* ->*", "go": "=> ?? ?. -> :: ** .. ..= ->* .* <=> =~ !~ &. === !== >>> ?", "rust": "=== !== ?? ?. ++ -- ** >>> >>>= ->* .* <=> =~ !~ &^ &^= := <- &.",
    "java": "=== !== ?? ?. ** => .. ..= ->* .* <=> =~ !~ &^ &^= := <- &.", "c": "=== !== ?? ?. ** => .. ..= <=> =~ !~ &^ &^= := <- &. >>> >>>= ::", "cpp": "=== !== ?? ?. ** => .. ..= =~ !~ &^ &^= := <- &. >>> >>>=",
    "ruby": "=== !== ?? ?. ++ -- -> ->* .* &^ &^= := <- ..= >>> >>>=",
}
# Words that are neither names nor operators.
WORDS = {
    "javascript": "abstract any async break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in infer instanceof interface is keyof let module namespace new of package private protected public readonly require return satisfies set static switch symbol throw try type typeof unique unknown var void while with yield never object asserts override accessor bigint as await boolean",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type union unsafe use where while macro_rules",
    "java": "abstract assert break case catch class const continue default do else enum exports extends final finally for goto if implements import instanceof interface module native new non-sealed open opens package permits private protected provides public record requires return sealed static strictfp switch synchronized throw throws to transient transitive try uses volatile when while with yield",
    "c": "alignas alignof auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while",
    "cpp": "alignas alignof asm break case catch class concept const consteval constexpr constinit continue co_await co_return co_yield decltype default delete do else enum explicit export extern final for friend goto if inline mutable namespace new noexcept operator override private protected public register requires return sizeof static static_assert struct switch template thread_local throw try typedef typename union using virtual volatile while and or not bitand bitor xor compl and_eq or_eq xor_eq not_eq",
    "ruby": "alias and begin break case class def defined? do else elsif end ensure for if in module next not or redo rescue retry return then undef unless until when while yield",
}
NUMBER = r"0[xXbBoO][0-9A-Fa-f_]+[A-Za-z0-9_]*|(?:\d[\d_]*)?\.?\d[\d_]*(?:\.(?!\.)[\d_]*)?(?:[eE][+-]?\d+)?[A-Za-z_0-9]*"
NAME = r"[^\W\d][\w$]*|\$[\w$]*"
STRINGS = re.compile(r"""(?s)"((?:\\.|[^"\\])*+)"|'((?:\\.|[^'\\])*+)'|`((?:\\.|[^`\\])*+)`""")
ESCAPED = re.compile(r"\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)", re.S)


def family(language: str) -> str:
    return "javascript" if language in ("jsx", "typescript", "tsx") else language


def scanner(language: str) -> re.Pattern:
    unused = set(NOT_IN[language].split())
    signs = "|".join(re.escape(s) for s in SIGNS if s not in unused)
    return re.compile(rf"(?P<string>{STRINGS.pattern[4:]})|(?P<name>@{{0,2}}(?:{NAME})[?!]?(?![=~])|{NAME})|(?P<number>{NUMBER})|(?P<sign>{signs})|(?P<other>\S)" if language == "ruby" else rf"(?P<string>{STRINGS.pattern[4:]})|(?P<name>{NAME})|(?P<number>{NUMBER})|(?P<sign>{signs})|(?P<other>\S)", re.S)


SCANNERS = {x: scanner(x) for x in WORDS}
KEPT = {x: frozenset(w.split()) for x, w in WORDS.items()}


def leaves(code: str, language: str) -> list[tuple[bool, str, int, int]]:
    """(is operand, text, line, column) of all leaves that count."""
    language = family(language)
    plain = list(code)
    for a, b in comments.spans(code, language):
        plain[a:b] = [c if c == "\n" else " " for c in plain[a:b]]
    text = "".join(plain)
    if language in ("c", "cpp"):
        text = re.sub(r"#\s*include\s*<[^>\n]*>|#\s*(?:if|ifdef|ifndef|elif|else|endif|define|undef|pragma|include)\b", lambda m: " " * len(m[0]), text)
    elif language == "go":
        text = re.sub(r"(?m)^package\s+\w+", lambda m: " " * len(m[0]), text)
    elif language == "javascript":
        text = re.sub(r"</|/>", "  ", text)
    out: list[tuple[bool, str, int, int]] = []
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = 0
    for m in SCANNERS[language].finditer(text):
        while line + 1 < len(starts) and starts[line + 1] <= m.start():
            line += 1
        said, at = m[0], (line + 1, m.start() - starts[line])
        kind = m.lastgroup
        if kind == "string":
            if language == "go":
                out.append((True, said, *at))
            elif language in ("rust", "java", "c", "cpp") and said[0] == "'":
                if language in ("rust", "java") or not ESCAPED.match(said[1:-1]):
                    out.append((True, said if language in ("rust", "java") else said[1:-1], *at))
            else:
                out += [(True, part, *at) for part in ESCAPED.split(said[1:-1]) if part]
        elif kind == "name":
            if said in OPERATOR_WORDS and said in KEPT[language]:
                out.append((False, said, *at))
            elif said not in KEPT[language]:
                out.append((True, said, *at))
        elif kind == "number":
            out.append((True, said, *at))
        elif kind == "sign" and (said != "?" or ternary(text, m.end())):
            out.append((False, said, *at))
    return out


def ternary(text: str, at: int) -> bool:
    """Whether a question mark asks, rather than marks something optional: what follows is not a closing sign or a colon."""
    rest = text[at : at + 40].lstrip()
    return bool(rest) and rest[0] not in ":,)];=>}"
