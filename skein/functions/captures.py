"""Captures: what the rules of a language find in one source text.

A capture is (tag, text, offset, end offset of what it spans).  Rules are data -
a pattern over the masked text and a tag - with a little code where balance of
brackets matters.  Python is read with its own parser where it parses.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

from skein.functions.languages import mask

CLASS, FUNCTION, INTERFACE, METHOD, ARROW, IMPORT, CALL, EXPORT = (
    "class", "function", "interface", "method", "variable", "import", "call", "export",
)


@dataclass(frozen=True)
class Capture:
    tag: str
    text: str
    start: int
    end: int


class Lines:
    def __init__(self, text: str):
        self.starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def at(self, offset: int) -> tuple[int, int]:
        row = bisect_right(self.starts, offset) - 1
        return row, offset - self.starts[row]


_PAIRS = {"(": ")", "{": "}", "[": "]"}
_BRACKET = re.compile(r"[(){}\[\]]")


class Brackets:
    """Which bracket closes which, each kind on its own, from one pass over a text."""

    def __init__(self, text: str):
        self.last, self.close, self.braces = len(text) - 1, {}, []
        open_: dict[str, list[int]] = {")": [], "}": [], "]": []}
        for m in _BRACKET.finditer(text):
            c = m.group()
            if c in _PAIRS:
                open_[_PAIRS[c]].append(m.start())
                if c == "{":
                    self.braces.append(m.start())
            elif open_[c]:
                self.close[open_[c].pop()] = m.start()

    def closing(self, at: int) -> int:
        """Offset of the bracket that closes the one at ``at``, or the last offset."""
        return self.close.get(at, self.last)

    def body_end(self, at: int) -> int:
        """Where the next braces from ``at`` on end; ``at`` if there are none."""
        i = bisect_left(self.braces, at)
        return self.closing(self.braces[i]) if i < len(self.braces) else at


class Spans:
    """Whether an offset lies inside any of some spans."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def __contains__(self, at: int) -> bool:
        i = bisect_left(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


def _before(code: str, at: int, n: int) -> str:
    """The ``n`` characters in front of ``at`` and of the white space there, however much."""
    while at > 0 and code[at - 1].isspace():
        at -= 1
    return code[max(0, at - n) : at]


# fixed values: words before a parenthesis that are no call
_TS_WORDS = frozenset("async if for while switch catch function return typeof await new super import class constructor do else in of void delete throw yield case instanceof".split())
_GO_WORDS = frozenset("func if for switch select return go defer interface struct map chan type var const range case else package import".split())
_PHP_WORDS = frozenset("if elseif while for foreach switch catch function fn return array isset empty list unset exit die print echo include require include_once require_once match use new and or xor declare static self parent class".split())
_BASH_WORDS = frozenset("if then else elif fi for while until do done case esac in select function time coproc local export declare readonly typeset unset [ [[ ]] ] { } ! ((".split())

_W = r"[A-Za-z_$][\w$]*"
_TS_CLASS = re.compile(rf"(?<![\w$.])class\s+({_W})")
_TS_FUNCTION = re.compile(rf"(?:^|[;{{}}])[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+({_W})\s*[(<]", re.M)
_TS_INTERFACE = re.compile(rf"(?<![\w$.])interface\s+({_W})")
_TS_METHOD = re.compile(rf"(?:^|[;{{}},])[ \t]*(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?\s*({_W})\s*(?:<[^<>()]*>)?\(", re.M)
_TS_ARROW = re.compile(rf"(?<![\w$.])(?:const|let)\s+({_W})\s*(?::[^=;]+)?=\s*(?:async\s+|async(?=\())?(?:<[^<>()]*>\s*)?(?:({_W})\s*=>|(\())")
_TS_IMPORT = re.compile(r"(?:^|;)[ \t]*import\s+(?:type\s+)?(?:[^;'\"()]*?\sfrom\s*)?(['\"])", re.M)
_TYPES = r"<(?:[^<>();{}]|<(?:[^<>();{}]|<[^<>();{}]*+>)*+>)*+>"
_TS_CALL = re.compile(rf"(?:(?<![\w$.#])|(?<=\.\.\.))({_W})\s*(?:\?\.\s*)?(?:{_TYPES}\s*)?\(")
_TS_EXPORT = re.compile(r"(?:^|[;}])[ \t]*(export)(?=[\s{*])", re.M)


_SPACE = re.compile(r"\s*")
_ATOM = re.compile(r"""[\w$]+|-\d[\w.]*|"[^"\n]*"|'[^'\n]*'|`[^`]*`""")
_ANGLES = re.compile(r"=>|[<>({\[]")
_TYPE_PREFIXES = frozenset("keyof typeof readonly unique infer asserts new abstract".split())


def _angle_end(code: str, at: int, brackets: Brackets) -> int:
    """Offset behind the angle bracket that closes the one at ``at``."""
    depth = 0
    while m := _ANGLES.search(code, at):
        at = m.end()
        if m.group() in _PAIRS:
            at = brackets.closing(m.start()) + 1
        elif m.group() != "=>":
            depth += 1 if m.group() == "<" else -1
            if depth == 0:
                return at
    return len(code)


def _behind_type(code: str, at: int, brackets: Brackets, arrow: bool = False) -> int:
    """Offset of what follows a return type annotation at ``at``, if there is one, of any
    length.  Of an ``arrow`` function the type ends at the first ``=>`` outside of brackets."""
    at = _SPACE.match(code, at).end()
    if not code.startswith(":", at):
        return at
    at, wanted = at + 1, True  # whether an operand has to follow
    while (at := _SPACE.match(code, at).end()) < len(code):
        c, word = code[at], _ATOM.match(code, at)
        if wanted and c in "({[":
            at, wanted = brackets.closing(at) + 1, False
        elif c == "[":
            at = brackets.closing(at) + 1
        elif c == "<":
            at = _angle_end(code, at, brackets)
        elif c in "|&" or not wanted and c in ".?:":
            at, wanted = at + 1, True
        elif not wanted and not arrow and code.startswith("=>", at):
            at, wanted = at + 2, True
        elif word and wanted:
            at, wanted = word.end(), word.group() in _TYPE_PREFIXES
        elif word and word.group() in ("is", "extends"):
            at, wanted = word.end(), True
        else:
            break
    return at


def _typescript(text: str, code: str) -> list[Capture]:
    out: list[Capture] = []
    declared: set[int] = set()
    brackets = Brackets(code)
    for m in _TS_CLASS.finditer(code):
        if _before(code, m.start(), 8).endswith(("abstract", "=", "(", "return", ",")):
            continue
        out.append(Capture(CLASS, m[1], m.start(1), brackets.body_end(m.end())))
    for m in _TS_FUNCTION.finditer(code):
        declared.add(m.start(1))
        out.append(Capture(FUNCTION, m[1], m.start(1), m.end(1)))
    for m in _TS_INTERFACE.finditer(code):
        out.append(Capture(INTERFACE, m[1], m.start(1), m.end(1)))
    for m in _TS_ARROW.finditer(code):
        if m[3]:
            if not code.startswith("=>", _behind_type(code, brackets.closing(m.start(3)) + 1, brackets, arrow=True)):
                continue
        out.append(Capture(ARROW, m[1], m.start(1), m.end(1)))
    for m in _TS_METHOD.finditer(code):
        if m[1] in _TS_WORDS and m[1] != "constructor" or m.start(1) in declared:
            continue
        if code.startswith("{", _behind_type(code, brackets.closing(m.end() - 1) + 1, brackets)):
            declared.add(m.start(1))
            out.append(Capture(METHOD, m[1], m.start(1), m.end(1)))
    for m in _TS_IMPORT.finditer(code):
        end = code.find(m[1], m.end())
        if end > 0:
            out.append(Capture(IMPORT, text[m.start(1) : end + 1], m.start(1), end))
    specs = Spans([(m.start(), brackets.body_end(m.end())) for m in _TS_INTERFACE.finditer(code)])
    for m in _TS_CALL.finditer(code):
        if m.start() in specs:
            continue  # what an interface asks for is no call
        before = _before(code, m.start(), 10)
        if m[1] in _TS_WORDS or m.start(1) in declared or re.search(r"(?:^|[^\w$.])(?:new|function|function\s*\*)$", before):
            continue
        out.append(Capture(CALL, m[1], m.start(1), m.end(1)))
    for m in _TS_EXPORT.finditer(code):
        ends = [i for i in (code.find("{", m.end()), code.find(";", m.end())) if i >= 0]
        at = min(ends) if ends else len(code) - 1
        out.append(Capture(EXPORT, "export", m.start(1), brackets.closing(at) if code[at] == "{" else at))
    return out


_PY_BREAK = re.compile(r"\r\n|\r|\n")
_PY_DEF = re.compile(r"(?:async(?:\s|\\\n)+)?(?:def|class)(?:\s|\\\n)+")
_PY_FROM = re.compile(r"from(?:\s|\\\n)+")


def _python(text: str, code: str) -> list[Capture]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_rules(text, code)
    starts = [0, *(m.end() for m in _PY_BREAK.finditer(text))]  # lines as its parser counts them

    def offset(row: int, utf8: int) -> int:
        end = starts[row] if row < len(starts) else len(text)
        return starts[row - 1] + len(text[starts[row - 1] : end].encode()[:utf8].decode(errors="ignore"))

    def behind(words: re.Pattern, row: int, utf8: int) -> int:
        m = words.match(text, offset(row, utf8))
        return m.end() if m else offset(row, utf8)

    out: list[Capture] = []
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            at = behind(_PY_DEF, node.lineno, node.col_offset)  # the name may be spelt in other letters there
            end = offset(node.end_lineno, node.end_col_offset) if isinstance(node, ast.ClassDef) else at + len(node.name)
            out.append(Capture(CLASS if isinstance(node, ast.ClassDef) else FUNCTION, node.name, at, max(at, end - 1)))
        elif isinstance(node, ast.Import):
            for alias in node.names:
                if alias.asname is None:
                    at = offset(alias.lineno, alias.col_offset)
                    out.append(Capture(IMPORT, alias.name, at, at + len(alias.name)))
        elif isinstance(node, ast.ImportFrom):
            if node.level == 0 and node.module and node.module != "__future__":
                at = behind(_PY_FROM, node.lineno, node.col_offset)
                out.append(Capture(IMPORT, node.module, at, at + len(node.module)))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                at = offset(f.lineno, f.col_offset)
                out.append(Capture(CALL, f.id, at, at + len(f.id)))
            elif isinstance(f, ast.Attribute):
                at = offset(f.end_lineno, f.end_col_offset) - len(f.attr)
                out.append(Capture(CALL, f.attr, at, at + len(f.attr)))
    return out


def _python_rules(text: str, code: str) -> list[Capture]:
    out = [Capture(CLASS, m[1], m.start(1), m.end(1)) for m in re.finditer(r"^[ \t]*class\s+(\w+)", code, re.M)]
    out += [Capture(FUNCTION, m[1], m.start(1), m.end(1)) for m in re.finditer(r"^[ \t]*(?:async\s+)?def\s+(\w+)", code, re.M)]
    out += [Capture(IMPORT, m[1], m.start(1), m.end(1)) for m in re.finditer(r"^[ \t]*from\s+([A-Za-z_][\w.]*)\s+import\b", code, re.M) if m[1] != "__future__"]
    for m in re.finditer(r"^[ \t]*import\s+([^\n;]+)", code, re.M):
        for part in re.finditer(r"([A-Za-z_][\w.]*)(\s+as\s+\w+)?\s*(?:,|$)", m[1].rstrip()):
            if not part[2]:
                out.append(Capture(IMPORT, part[1], m.start(1) + part.start(1), m.start(1) + part.end(1)))
    skip = {"if", "elif", "while", "for", "in", "and", "or", "not", "return", "yield", "lambda", "print_", "del", "assert", "with", "except", "class", "def", "is", "await", "else", "raise", "from", "import"}
    for m in re.finditer(r"(?<!\w)([A-Za-z_]\w*)\s*\(", code):
        if m[1] not in skip and not re.search(r"(?<!\w)(?:def|class)$", _before(code, m.start(), 6)):
            out.append(Capture(CALL, m[1], m.start(1), m.end(1)))
    return out


def _go(text: str, code: str) -> list[Capture]:
    out: list[Capture] = []
    brackets = Brackets(code)
    groups = Spans([(m.start(), brackets.closing(m.end() - 1)) for m in re.finditer(r"\btype\s*\(", code)])
    for m in re.finditer(r"(?:\btype\s+|^[ \t]+)(\w+)\s+(struct|interface)\s*\{", code, re.M):
        if m[0].lstrip().startswith("type") or m.start(1) in groups:
            tag = CLASS if m[2] == "struct" else INTERFACE
            out.append(Capture(tag, m[1], m.start(1), brackets.body_end(m.end(2)) if tag == CLASS else m.end(1)))
    specs = Spans([(m.start(), brackets.body_end(m.end() - 1)) for m in re.finditer(r"\binterface\s*\{", code)])
    declared = set()
    for m in re.finditer(r"^func\s+(?:(\([^)]*\))\s*)?(\w+)", code, re.M):
        declared.add(m.start(2))
        out.append(Capture(METHOD if m[1] else FUNCTION, m[2], m.start(2), m.end(2)))
    for m in re.finditer(r"^import\s*(\()?", code, re.M):
        end = brackets.closing(m.end() - 1) if m[1] else code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code)
        for s in re.finditer(r'"([^"]*)"', text[m.end() : end]):
            at = m.end() + s.start()
            if code[at] == '"':
                out.append(Capture(IMPORT, s[0], at, at + len(s[0])))
    for m in re.finditer(r"(?<!\w)(\w+)(?:\[[^\[\](){};\n]*+(?:\[[^\[\](){};\n]*+\][^\[\](){};\n]*+)*+\])?\(", code):
        if m.start() in specs:
            continue  # what an interface asks for is no call
        if m[1] not in _GO_WORDS and m.start(1) not in declared and not m[1][0].isdigit():
            out.append(Capture(CALL, m[1], m.start(1), m.end(1)))
    return out


def _php(text: str, code: str) -> list[Capture]:
    out: list[Capture] = []
    brackets = Brackets(code)
    spans: list[tuple[int, int]] = []
    for m in re.finditer(r"(?<![\w$>:\\])(class|interface|trait)\s+(\w+)", code):
        if _before(code, m.start(), 3).endswith(("new", "::")):
            continue
        end = brackets.body_end(m.end())
        spans.append((m.start(), end))
        if m[1] == "class":
            out.append(Capture(CLASS, m[2], m.start(2), end))
        elif m[1] == "interface":
            out.append(Capture(INTERFACE, m[2], m.start(2), m.end(2)))
    declared, bodies = set(), Spans(spans)
    for m in re.finditer(r"(?<![\w$])function\s+&?\s*(\w+)\s*\(", code):
        declared.add(m.start(1))
        tag = METHOD if m.start() in bodies else FUNCTION
        out.append(Capture(tag, m[1], m.start(1), m.end(1)))
    for m in re.finditer(r"^[ \t]*use\s+(?:function\s+|const\s+)?([^;({]+)", code, re.M):
        if m.start() in bodies:
            continue
        for part in re.finditer(r"\\?\w+(?:\\\w+)+", m[1]):
            out.append(Capture(IMPORT, part[0], m.start(1) + part.start(), m.start(1) + part.end()))
    for m in re.finditer(r"(?<![\w\\$])(\\?[A-Za-z_]\w*(?:\\\w+)*)\s*\(", code):
        before = _before(code, m.start(), 8)
        if m.start(1) in declared or before.endswith("?->"):
            continue
        member = before.endswith(("->", "::"))
        if not member and (m[1].lower() in _PHP_WORDS or before.endswith(("new", "function", "#["))):
            continue
        out.append(Capture(CALL, m[1], m.start(1), m.end(1)))
    return out


_BASH_SPLIT = re.compile(r"[\n;|&(){}`]|\$\(|(?<!\S)(?:then|do|else|elif|if|while|until|!)(?!\S)")
_BASH_ASSIGN = re.compile(r"\s*[A-Za-z_]\w*(?:\[[^\]]*\])?\+?=(?:\([^)]*\)|\"[^\"]*\"|'[^']*'|\S*)")


def _bash(text: str, code: str) -> list[Capture]:
    out: list[Capture] = []
    code = re.sub(r"\$\{[^}\n]*\}", lambda m: "$" + "_" * (len(m[0]) - 1), code)
    heads: set[int] = set()
    for m in re.finditer(r"^[ \t]*(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))", code, re.M):
        at = m.start(1) if m[1] else m.start(2)
        heads.add(at)
        out.append(Capture(FUNCTION, m[1] or m[2], at, at + len(m[1] or m[2])))
    cuts = [0, *[m.end() for m in _BASH_SPLIT.finditer(code)]]
    for a, b in zip(cuts, [*cuts[1:], len(code)]):
        at = a
        while (m := _BASH_ASSIGN.match(code, at, b)) and m.end() > at:
            at = m.end()
        m = re.compile(r"\s*([^\s;|&(){}<>`\"'=]+)").match(code, at, b)
        if not m or m.start(1) in heads or m[1] in _BASH_WORDS or m[1][0] in "$#-" or m[1][-1] == ")":
            continue
        line = code[max(code.rfind("\n", 0, m.start(1)), code.rfind(";", 0, m.start(1))) + 1 : m.start(1)]  # of the line what follows the last ;
        if re.search(r"(?:\bfor|\bcase|\bselect|\bfunction|<<?)$", _before(code, m.start(1), 9)) or re.search(r"\bin\s", line) and "case" not in line:
            continue
        if code[m.end(1) : m.end(1) + 1] == ")":
            continue  # a pattern of a case
        out.append(Capture(CALL, m[1], m.start(1), m.end(1)))
        if m[1] in ("source", "."):
            arg = re.compile(r"[ \t]+([^\s;|&\"'$`]+)(?=[\s;|&]|$)").match(code, m.end(1))
            if arg:
                out.append(Capture(IMPORT, arg[1], arg.start(1), arg.end(1)))
    return out


_READERS = {"typescript": _typescript, "tsx": _typescript, "python": _python, "go": _go, "php": _php, "bash": _bash}
#: At one place an export comes before what it exports.
_RANK = {EXPORT: 0, CLASS: 1}


def captures_of(text: str, language: str) -> list[tuple[int, str, str, int, int, int, str]]:
    """(idx, tag, text, startrow, startcol, endrow, line) in the order of the text."""
    code = mask(text, language)
    lines = Lines(text)
    rows = text.split("\n")
    found = sorted(set(_READERS[language](text, code)), key=lambda c: (c.start, _RANK.get(c.tag, 2), c.tag))
    out = []
    for i, c in enumerate(found):
        row, col = lines.at(c.start)
        out.append((i, c.tag, c.text, row, col, lines.at(max(c.start, c.end))[0], rows[row].strip()))
    return out
