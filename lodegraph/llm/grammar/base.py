"""Tokens and the walk over them that the grammars share."""

from __future__ import annotations

PAIRS = {"(": ")", "[": "]", "{": "}"}
CLOSERS = {")": "(", "]": "[", "}": "{"}


class Invalid(Exception):
    """A text that its grammar does not accept."""


class Tokens:
    """Kinds (n name, k reserved word, d number, s string, r regular expression, p sign, e end), values, whether a line break
    stands before, places, and for each opening bracket the number of its closing one."""

    def __init__(self) -> None:
        self.kind: list[str] = []
        self.value: list[str] = []
        self.fresh: list[bool] = []
        self.place: list[int] = []
        self.match: dict[int, int] = {}
        self.opener: dict[int, int] = {}
        self._open: list[int] = []

    def add(self, kind: str, value: str, fresh: bool, place: int) -> None:
        if kind == "p":
            if value in PAIRS:
                self._open.append(len(self.value))
            elif value in CLOSERS:
                if not self._open or self.value[self._open[-1]] != CLOSERS[value]:
                    raise Invalid(f"'{value}' at {place} closes nothing")
                self.opener[len(self.value)] = at = self._open.pop()
                self.match[at] = len(self.value)
        self.kind.append(kind)
        self.value.append(value)
        self.fresh.append(fresh)
        self.place.append(place)

    def end(self, place: int) -> None:
        if self._open:
            at = self._open[-1]
            raise Invalid(f"'{self.value[at]}' at {self.place[at]} is never closed")
        for _ in range(3):
            self.add("e", "", True, place)


class Walk:
    """A parser's place in the tokens."""

    def __init__(self, tokens: Tokens) -> None:
        self.t, self.k, self.v, self.i = tokens, tokens.kind, tokens.value, 0

    def fail(self, why: str = "unexpected") -> None:
        i = min(self.i, len(self.v) - 1)
        raise Invalid(f"{why} {self.v[i]!r} at {self.t.place[i]}")

    def sign(self, value: str) -> bool:
        """Whether the sign or reserved word ``value`` comes next."""
        return self.v[self.i] == value and self.k[self.i] in "pk"

    def take(self, value: str) -> bool:
        if self.v[self.i] == value and self.k[self.i] in "pk":
            self.i += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            self.fail(f"expected {value!r}, not")

    def word(self, value: str) -> bool:
        """Whether the name or reserved word ``value`` comes next."""
        return self.v[self.i] == value and self.k[self.i] in "nk"

    def name(self) -> None:
        if self.k[self.i] != "n":
            self.fail("expected a name, not")
        self.i += 1
