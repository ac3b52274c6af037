"""Chunks of a source file as maps of lexer states and as bracket summaries, which compose associatively.

A chunk begins and ends at line breaks. For each state that a line can begin in - code, a block comment, a literal over several
lines - its map tells the state after it, the brackets it closes that were opened before it, and those it leaves open. Two maps
compose into the map of both chunks together, whatever stands around them, so the chunks of a file may be read and
reduced anywhere in any grouping. None stands for a state in which no line of the language begins, or for a mismatch."""

from __future__ import annotations

import re

from .grammar.base import CLOSERS, PAIRS

CODE, COMMENT, LITERAL = "code", "comment", "literal"
State = tuple[str, str, str]  # state after, closing brackets, opening brackets
Map = dict[str, State | str]

_PARTS = {
    "java": re.compile(r"//[^\n\r]*|/\*|\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\.)*'|[()\[\]{}]|[\"']"),
    "go": re.compile(r"//[^\n\r]*|/\*|`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[()\[\]{}]|[\"']"),
}
_LITERAL_END = {"java": re.compile(r"(?s:(?:[^\\]|\\.)*?)\"\"\""), "go": re.compile(r"(?s:.*?)`")}
#: Languages whose lexer needs no more than these states: what a sign means never depends on the tokens before it.
LANGUAGES = set(_PARTS)


def chunk_state(text: str, language: str, state: str) -> State | str:
    """The state after a chunk that begins in ``state``, and its brackets; or what is wrong with it."""
    parts, ends = _PARTS[language], _LITERAL_END[language]
    close, open_, i = [], [], 0
    while True:
        if state == COMMENT:
            i = text.find("*/", i)
            if i < 0:
                return COMMENT, "".join(close), "".join(open_)
            i, state = i + 2, CODE
        elif state == LITERAL:
            m = ends.match(text, i)
            if not m:
                return LITERAL, "".join(close), "".join(open_)
            i, state = m.end(), CODE
        m = parts.search(text, i)
        if not m:
            return CODE, "".join(close), "".join(open_)
        part, i = m[0], m.end()
        if part in PAIRS:
            open_.append(part)
        elif part in CLOSERS:
            if not open_:
                close.append(part)
            elif open_.pop() != CLOSERS[part]:
                return f"'{part}' closes another bracket"
        elif part == "/*":
            state = COMMENT
        elif part in ("`", '"""'):
            state = LITERAL
        elif part in ('"', "'"):
            return f"{part} without end in its line"


def chunk_map(text: str, language: str) -> Map:
    return {s: chunk_state(text, language, s) for s in (CODE, COMMENT, LITERAL)}


def compose(a: Map, b: Map) -> Map:
    """The map of two chunks one after the other."""
    out: Map = {}
    for start, first in a.items():
        if isinstance(first, str):
            out[start] = first
            continue
        then = b[first[0]]
        if isinstance(then, str):
            out[start] = then
            continue
        n = min(len(first[2]), len(then[1]))
        inner = first[2][len(first[2]) - n :][::-1]
        if any(PAIRS[x] != y for x, y in zip(inner, then[1])):
            out[start] = "a bracket is closed by another kind"
        else:
            out[start] = (then[0], first[1] + then[1][n:], first[2][: len(first[2]) - n] + then[2])
    return out


def verdict(whole: Map) -> str | None:
    """What is wrong with a file whose map is given, as far as states and brackets tell."""
    end = whole[CODE]
    if isinstance(end, str):
        return end
    state, close, open_ = end
    if state != CODE:
        return f"{state} without end"
    if close:
        return f"'{close[0]}' closes nothing"
    return f"'{open_[-1]}' is never closed" if open_ else None


def chunks(text: str, size: int) -> list[str]:
    """Chunks of about ``size`` characters that end at line breaks (a line longer than that is a chunk of its own)."""
    out, i = [], 0
    while i < len(text):
        end = text.find("\n", i + size)
        end = len(text) if end < 0 else end + 1
        out.append(text[i:end])
        i = end
    return out or [""]


_HEADS = re.compile(r"(?:func|var|const|type|import)\b")


def _depths(text: str, language: str):
    """(place behind it, part, depth behind it) of the brackets and line breaks in the code of a balanced text."""
    parts, ends = re.compile(_PARTS[language].pattern + r"|\n"), _LITERAL_END[language]
    i, depth = 0, 0
    while m := parts.search(text, i):
        part, i = m[0], m.end()
        if part == "/*":
            i = text.find("*/", i) + 2
        elif part in ("`", '"""'):
            i = ends.match(text, i).end()
        elif part in PAIRS:
            depth += 1
        elif part in CLOSERS:
            depth -= 1
        if part in CLOSERS or part == "\n":
            yield i, part, depth


def statements(text: str, language: str) -> list[str]:
    """The top-level statements of a balanced text, each a text that stands for itself: in Java what ends with a brace outside of
    all brackets, in Go what begins a line there with a declaration's word. One, the whole, where imports would come late."""
    cuts = [0]
    for at, part, depth in _depths(text, language):
        if depth == 0 and (part == "}" if language == "java" else part == "\n" and _HEADS.match(text, at)):
            cuts.append(at)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    out = [text[a:b] for a, b in zip(cuts, cuts[1:])]
    if language == "java":
        return [text] if any(re.search(r"^\s*(?:import|package)\b", p, re.M) for p in out[1:]) else out or [text]
    late = [n for n, p in enumerate(out[1:]) if p.startswith("import")]
    if late != list(range(len(late))):
        return [text]
    return [p if n == 0 else f"package p\n{p}" for n, p in enumerate(out)]
