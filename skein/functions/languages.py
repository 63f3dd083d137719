"""Languages that can be scanned, and how source text is masked.

Masking blanks comments and the inside of string literals and keeps every
offset, so that rules see only code and can still read literals from the
original text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Language:
    """One language profile; ``hook`` may rework the nodes and edges of its files."""

    name: str
    extensions: tuple[str, ...]
    hook: Callable | None = field(default=None, compare=False)


# fixed values: which extension is which language
PROFILES = (
    Language("typescript", (".ts",)),
    Language("tsx", (".tsx",)),
    Language("python", (".py", ".pyw")),
    Language("go", (".go",)),
    Language("php", (".php",)),
    Language("bash", (".sh", ".bash")),
)


class Registry:
    """Extension to language; a later registration of an extension wins."""

    def __init__(self, profiles: tuple[Language, ...] = PROFILES):
        self.by_extension: dict[str, Language] = {}
        for p in profiles:
            self.register(p)

    def register(self, profile: Language) -> None:
        for ext in profile.extensions:
            self.by_extension[ext] = profile

    def language_of(self, ext: str) -> str | None:
        profile = self.by_extension.get(ext)
        return profile.name if profile else None

    def extensions(self) -> list[str]:
        return list(self.by_extension)

    def hooks(self) -> dict[str, Callable]:
        return {p.name: p.hook for p in self.by_extension.values() if p.hook}


_C_LIKE = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
)
_PHP = re.compile(
    r"""(?P<comment>//[^\n]*|\#(?!\[)[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)"""
)
_PYTHON = re.compile(
    r'''(?P<comment>\#[^\n]*)|(?P<string>"""[\s\S]*?(?:"""|\Z)|\'\'\'[\s\S]*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)'''
)
_BASH = re.compile(
    r"""(?P<heredoc><<-?\s*(['"]?)(?P<tag>\w+)\2[^\n]*\n[\s\S]*?(?:^[ \t]*(?P=tag)[ \t]*$|\Z))|(?P<comment>(?:^|(?<=[\s;]))\#[^\n]*)|(?P<string>"(?:\\.|[^"\\])*"?|'[^']*'?)""",
    re.M,
)
_MASKS = {"typescript": _C_LIKE, "tsx": _C_LIKE, "go": _C_LIKE, "php": _PHP, "python": _PYTHON, "bash": _BASH}
_VISIBLE = re.compile(r"[^\n]")


def without_comments(text: str, language: str) -> str:
    """``text`` with comments blanked, offsets and string literals unchanged; an unknown
    language is read like one that writes // and /* */."""

    def blank(m: re.Match) -> str:
        return _VISIBLE.sub(" ", m.group(0)) if m.group("comment") else m.group(0)

    return _MASKS.get(language, _C_LIKE).sub(blank, text)


_TEMPLATE = re.compile(r"\\[\s\S]|`|\$\{")
_IN_TEMPLATE = re.compile(
    r"""(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?)|(?P<mark>[`{}])"""
)


def _mask_templates(text: str, blank: Callable[[re.Match], str]) -> str:
    """Like the mask of C-like languages, but what a template literal inserts stays code."""
    out: list[str] = []
    open_: list[int] = []  # of every inserted piece of code how many braces are open in it
    at = 0
    while m := _IN_TEMPLATE.search(text, at):
        out.append(text[at : m.start()])
        at, mark = m.end(), m.group("mark")
        if not mark:
            out.append(blank(m))
            continue
        if mark == "{" and open_:
            open_[-1] += 1
        elif mark == "}" and open_:
            open_[-1] -= 1
        out.append(mark)
        if mark == "`" or mark == "}" and open_ and open_[-1] < 0:  # a literal begins, or goes on
            if mark == "}":
                open_.pop()
            while True:
                t = _TEMPLATE.search(text, at)
                end = t.end() if t else len(text)
                if not t or t.group() == "`":
                    out.append(_VISIBLE.sub(" ", text[at : end - bool(t)]) + "`" * bool(t))
                    at = end
                    break
                if t.group() == "${":
                    out.append(_VISIBLE.sub(" ", text[at : end - 1]) + "{")
                    open_.append(0)
                    at = end
                    break
                out.append(_VISIBLE.sub(" ", text[at:end]))
                at = end
    out.append(text[at:])
    return "".join(out)


def mask(text: str, language: str) -> str:
    """``text`` with comments and string contents blanked, offsets unchanged."""

    def blank(m: re.Match) -> str:
        whole = m.group(0)
        if m.lastgroup == "comment" or m.group("comment"):
            return _VISIBLE.sub(" ", whole)
        if "heredoc" in m.groupdict() and m.group("heredoc"):
            return _VISIBLE.sub(" ", whole)
        if len(whole) < 2:
            return whole
        return whole[0] + _VISIBLE.sub(" ", whole[1:-1]) + whole[-1]

    if "`" in text and language in ("typescript", "tsx"):
        return _mask_templates(text, blank)
    return _MASKS[language].sub(blank, text)
