"""Local grammars: each tells whether a source text is syntactically valid in its language."""

from __future__ import annotations

import ast
import sys
import threading
import warnings
from collections.abc import Callable

from .base import Invalid
from .go import check_go
from .java import check_java
from .script import check_script

__all__ = ["Invalid", "LANGUAGES", "problem"]

#: The language an extension stands for.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "java": "java", "go": "go"}


#: Bytes of stack of the thread that reads deeply nested texts; pages that are not used take no memory.
STACK = 512 << 20


def _deep(check: Callable[[], None], frames: int) -> None:
    """Runs a check in a thread of its own with a stack and a recursion limit that fit the text."""
    failed: list[BaseException] = []

    def run() -> None:
        try:
            check()
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    limit, size = sys.getrecursionlimit(), threading.stack_size(STACK)
    sys.setrecursionlimit(max(limit, frames))
    try:
        thread = threading.Thread(target=run)
        thread.start()
        thread.join()
    finally:
        sys.setrecursionlimit(limit)
        threading.stack_size(size)
    if failed:
        raise failed[0]


def problem(text: str, language: str) -> str | None:
    """What is wrong with a text in a language, or None. A byte order mark at the start does no harm. Nesting may be as deep as
    the text is long, but for Python, where what its own parser refuses as too deep is invalid."""
    text = text.removeprefix("\ufeff")
    check = {"java": lambda: check_java(text), "go": lambda: check_go(text)}.get(language, lambda: check_script(text, language == "typescript"))
    try:
        if language == "python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        else:
            try:
                check()
            except RecursionError:
                _deep(check, 32 * len(text) + 1000)
    except Invalid as e:
        return str(e)
    except SyntaxError as e:
        return f"line {e.lineno}: {e.msg}"
    except ValueError as e:
        return str(e)
    except (RecursionError, MemoryError):
        return "nested too deeply"
    return None
