"""Articles in markup as the words a reader sees.

Comments and notes are read too. Macros that the text defines itself are expanded; markup, citation marks, labels, index
entries, line breaks and hyphenation leave no trace between words. Words are maximal runs of a-z and digits.
"""

from __future__ import annotations

import re

# Commands by what they leave in print.
_INVISIBLE = "label|index|glossary|hypertarget|phantomsection|vspace|hspace|setlength|setcounter|addtocounter|color|pagestyle|thispagestyle"
_REPLACED = (
    r"[a-zA-Z]*cite[a-zA-Z]*|ref|eqref|pageref|autoref|[cC]ref|nameref|input|include|includegraphics|bibitem|bibliography|bibliographystyle|"
    r"begin|end|usepackage|documentclass|url|graphicspath|newtheorem|hypersetup"
)
_STYLE = (
    r"emph|text[a-z]{0,10}|math[a-z]{0,6}|it|bf|rm|sf|tt|sc|sl|em|itshape|bfseries|scshape|slshape|upshape|rmfamily|sffamily|ttfamily|mdseries|normalfont|"
    r"tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge|mbox|underline|uline|ensuremath|hbox|MakeUppercase|uppercase|lowercase|protect|relax|null"
)
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "­": ""}

_definition = re.compile(r"\\(?:(?:re)?newcommand|providecommand|DeclareRobustCommand|DeclareMathOperator)\*?\s*(?:\{\s*\\([a-zA-Z@]+)\s*\}|\\([a-zA-Z@]+))\s*(?:\[(\d)\])?\s*(?:\[([^\]]*)\])?\s*(?=\{)|\\[egx]?def\s*\\([a-zA-Z@]+)\s*((?:#\d)*)\s*(?=\{)")
_parts = re.compile(
    rf"(?P<gone>\\-|\\/|\\@|\\(?:{_INVISIBLE})(?![a-zA-Z])\*?(?:\s*\[[^\]]*\])*\s*(?:\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})?(?:\s*\[[^\]]*\])*|\\(?:{_STYLE})(?![a-zA-Z@])\*?[ \t]*)"
    rf"|\\(?:{_REPLACED})(?![a-zA-Z])\*?(?:\s*\[[^\]]*\])*\s*(?:\{{[^{{}}]*\}})?|\\[a-zA-Z@]+\*?|\\."
, re.S)
_hyphen = re.compile(r"(?<=[^\W_])-[ \t]*\r?\n[ \t%]*(?=[^\W_])")
_ended = re.compile(r"(?<=[^\W_])%\r?\n[ \t]*(?=[^\W_])")
_word = re.compile(r"[a-z0-9]+")
_ligature = re.compile("[" + "".join(_LIGATURES) + "]")
#: Letters of expanded text in all, for each letter of the text, after which no further macro is expanded, so that those that contain or double themselves end.
GROWTH = 20


_brace = re.compile(r"\\.|[{}]|\n[ \t]*\r?\n", re.S)


def _group(text: str, at: int) -> tuple[str, int]:
    """The content of the group opening at `at`, and the place after it; an unclosed group ends at a blank line or the end."""
    depth, blank = 0, None
    for m in _brace.finditer(text, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return text[at + 1 : m.start()], m.end()
        elif c[0] == "\n" and blank is None:
            blank = m.start()
    end = len(text) if blank is None else blank
    return text[at + 1 : end], end


def _without_definitions(text: str) -> tuple[str, dict[str, tuple[int, str | None, str]]]:
    """The text without macro definitions, and the macros: name to (arguments, default of the first, body)."""
    macros: dict[str, tuple[int, str | None, str]] = {}
    kept, at = [], 0
    while m := _definition.search(text, at):
        kept.append(text[at : m.start()])
        body, at = _group(text, m.end())
        if m[5]:
            macros[m[5]] = (len(m[6]) // 2, None, body)
        else:
            macros[m[1] or m[2]] = (int(m[3] or 0), m[4], body)
    return "".join(kept) + text[at:], macros


def _expanded(text: str, macros: dict[str, tuple[int, str | None, str]]) -> str:
    """All macros expanded, those within macros too, however deep. A macro within its own expansion is left as it is, as it would not end."""
    used = re.compile(r"\\(" + "|".join(map(re.escape, sorted(macros, key=len, reverse=True))) + r")(?![a-zA-Z@])[ \t]*")
    budget = [GROWTH * len(text) + 10_000]

    def expand(text: str, within: frozenset[str]) -> str:
        kept, at = [], 0
        for m in used.finditer(text):
            if m.start() < at or m[1] in within or budget[0] < 0:
                continue
            n, default, body = macros[m[1]]
            kept.append(text[at : m.start()])
            at = m.end()
            arguments = []
            if n and default is not None:
                arguments.append(default)
                if text.startswith("[", at) and (close := text.find("]", at)) > 0:
                    arguments[0], at = text[at + 1 : close], close + 1
            while len(arguments) < n:
                if text.startswith("{", at):
                    argument, at = _group(text, at)
                else:
                    argument, at = text[at : at + 1], at + 1
                # arguments stand where the macro is used, so they are expanded as that place is
                arguments.append(expand(argument, within))
            filled = re.sub(r"#(\d)", lambda a: arguments[int(a[1]) - 1] if 0 < int(a[1]) <= n else "", body) if "#" in body else body
            budget[0] -= len(filled)
            kept.append(expand(filled, within | {m[1]}))
        return "".join(kept) + text[at:] if kept else text

    try:
        return expand(text, frozenset())
    except RecursionError:  # macros nested some hundreds deep
        return text


def typeset(text: str) -> str:
    """The text as printed, as far as its words go; signs other than letters and digits may be left or missing."""
    if _ligature.search(text):
        text = _ligature.sub(lambda m: _LIGATURES[m.group()], text)
    if "\\" in text:
        text, macros = _without_definitions(text)
        if macros:
            text = _expanded(text, macros)
        text = _parts.sub(lambda m: "" if m.lastgroup else " ", text)
    if "-" in text:
        text = _hyphen.sub("", text)
    if "%" in text:
        text = _ended.sub("", text)
    return text.replace("}{", " ").replace("{", "").replace("}", "")


def words(text: str | None) -> list[str]:
    """Lower-case words of the text as printed; none for null."""
    return _word.findall(typeset(text).lower()) if text else []


def plain_words(text: str | None) -> list[str]:
    """Lower-case words of a text without markup; none for null."""
    return _word.findall(text.lower()) if text else []
