"""Go."""

from __future__ import annotations

import re

from .base import Invalid, Tokens, Walk

_RESERVED = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_SPACE = re.compile(r"[ \t\r]+")
_TOKEN = re.compile(
    r"(?P<n>[^\W\d]\w*)|(?P<d>0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bB][01_]+i?|0[oO][0-7_]+i?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)"
    r"|(?P<s>`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[abfnrtv\\']|\\x[0-9a-fA-F]{2}|\\[0-7]{3}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})')"
    r"|(?P<p><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])"
)
_ENDS = {"break", "continue", "fallthrough", "return"}
_ASSIGN = {"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="}
_BINARY = {"+", "-", "*", "/", "%", "&", "|", "^", "<<", ">>", "&^", "&&", "||", "==", "!=", "<", "<=", ">", ">="}
_UNARY = {"+", "-", "!", "^", "*", "&", "<-", "~"}


def _lex(text: str) -> Tokens:
    """Tokens, with the semicolons that line ends stand for."""
    out, i, n = Tokens(), 0, len(text)
    ends = False
    while i < n:
        c = text[i]
        if c in " \t\r":
            i = _SPACE.match(text, i).end()
            continue
        if c == "\n":
            if ends:
                out.add("p", ";", True, i)
                ends = False
            i += 1
            continue
        if c == "/" and text.startswith("//", i):
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        if c == "/" and text.startswith("/*", i):
            end = text.find("*/", i + 2)
            if end < 0:
                raise Invalid(f"comment at {i} is never closed")
            if ends and "\n" in text[i:end]:
                out.add("p", ";", True, i)
                ends = False
            i = end + 2
            continue
        m = _TOKEN.match(text, i)
        if not m:
            raise Invalid(f"unexpected character {c!r} at {i}")
        kind, value = m.lastgroup, m[0]
        if kind == "n" and value in _RESERVED:
            kind = "k"
        elif kind == "d" and m.end() < n and (text[m.end()].isalnum() or text[m.end()] == "_"):
            raise Invalid(f"a name follows a number at {i}")
        elif kind == "s":
            value = '""'
        out.add(kind, value, False, i)
        ends = kind in "nds" or (kind == "p" and value in (")", "]", "}", "++", "--")) or (kind == "k" and value in _ENDS)
        i = m.end()
    if ends:
        out.add("p", ";", True, n)
    out.end(n)
    return out


class Go(Walk):
    level = 0  # below 0 in the head of a statement, where a brace begins its block

    def file(self) -> None:
        self.need("package")
        self.name()
        self.need(";")
        while self.take("import"):
            self.group(self.import_spec)
            self.need(";")
        while self.k[self.i] != "e":
            if self.take("func"):
                self.func_decl()
            elif self.sign("var") or self.sign("const") or self.sign("type"):
                self.declaration()
            else:
                self.fail("expected a declaration, not")
            if self.k[self.i] != "e":
                self.need(";")

    def group(self, spec) -> None:
        if self.take("("):
            while not self.take(")"):
                spec()
                if not self.sign(")"):
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if self.k[self.i] == "n" or self.sign("."):
            self.i += 1
        if self.k[self.i] != "s":
            self.fail("expected a path, not")
        self.i += 1

    def declaration(self) -> None:
        v = self.v[self.i]
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[v])

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.take("="):
            return self.expressions()
        self.type()
        if self.take("="):
            self.expressions()
        return None

    def const_spec(self) -> None:
        self.names()
        if not (self.sign("=") or self.sign(";") or self.sign(")")):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.sign("[") and self.k[self.i + 1] == "n" and self.v[self.i + 2] != "]":
            keep = self.i
            try:
                self.type_parameters()
            except Invalid:
                self.i = keep
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.sign("]"):
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def func_decl(self) -> None:
        if self.sign("("):
            self.parameters()
        self.name()
        if self.sign("["):
            self.type_parameters()
        self.signature()
        if self.sign("{"):
            self.body()

    def body(self) -> None:
        keep, self.level = self.level, 0
        self.block()
        self.level = keep

    def signature(self) -> None:
        self.parameters()
        if self.sign("("):
            self.parameters()
        elif self.type_ahead():
            self.type()

    def parameters(self) -> None:
        """All entries are types, or all are names with types."""
        self.need("(")
        keep = self.i
        named = False
        while not self.take(")"):
            if self.k[self.i] == "n" and not (self.k[self.i + 1] == "p" and self.v[self.i + 1] in (",", ")", ".")) and not (self.v[self.i + 1] == "[" and self._generic()):
                self.i += 1
                named = True
            self.take("...")
            self.type()
            if not self.sign(")"):
                self.need(",")
        if named:
            end, self.i = self.i, keep
            open_ = False
            while not self.take(")"):
                if self.k[self.i] == "n" and self.v[self.i + 1] in (",", ")"):
                    self.i += 1
                    open_ = True
                elif self.k[self.i] == "n":
                    self.i += 1
                    self.take("...")
                    self.type()
                    open_ = False
                else:
                    self.fail("mixed parameters at")
                if not self.sign(")"):
                    self.need(",")
            if open_:
                self.fail("mixed parameters before")
            self.i = end

    def _generic(self) -> bool:
        """Whether name[...] is an instantiated type and not a name with an array or slice type."""
        end = self.t.match[self.i + 1]
        return end > self.i + 2 and self.k[self.i + 2] == "n" and self.v[end + 1] in (",", ")")

    def type_ahead(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        return k == "n" or (k == "k" and v in ("chan", "func", "interface", "map", "struct")) or (k == "p" and v in ("*", "[", "(", "<-"))

    def type(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "n":
            self.i += 1
            if self.take("."):
                self.name()
            if self.sign("[") and self.v[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.take(","):
                    if self.sign("]"):
                        break
                    self.type()
                self.need("]")
        elif v == "*" and k == "p":
            self.i += 1
            self.type()
        elif v == "(" and k == "p":
            self.i += 1
            self.type()
            self.need(")")
        elif v == "[" and k == "p":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    keep, self.level = self.level, self.level + 1
                    self.expression()
                    self.level = keep
                self.need("]")
            self.type()
        elif v == "<-" and k == "p":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "k" and v == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif k == "k" and v == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "k" and v == "func":
            self.i += 1
            self.signature()
        elif k == "k" and v == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.field()
                if not self.sign("}"):
                    self.need(";")
        elif k == "k" and v == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.k[self.i] == "n" and self.v[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                if not self.sign("}"):
                    self.need(";")
        else:
            self.fail("expected a type, not")

    def field(self) -> None:
        if self.take("*"):
            self.type()
        elif self.k[self.i] == "n" and self.v[self.i + 1] in (";", "}", ".") or (self.k[self.i] == "n" and self.k[self.i + 1] == "s"):
            self.type()
        else:
            self.names()
            self.type()
        if self.k[self.i] == "s":
            self.i += 1

    # statements

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not (self.sign("}") or self.sign("case") or self.sign("default")):
            self.statement()
            if self.sign("}"):
                return
            self.need(";")

    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "p" and v in (";", "}"):
            return None
        if k == "p" and v == "{":
            return self.block()
        if k == "k":
            if v in ("var", "const", "type"):
                return self.declaration()
            if v in ("return",):
                self.i += 1
                if not (self.sign(";") or self.sign("}")):
                    self.expressions()
                return None
            if v in ("break", "continue", "goto"):
                self.i += 1
                if self.k[self.i] == "n":
                    self.i += 1
                return None
            if v == "fallthrough":
                self.i += 1
                return None
            if v in ("go", "defer"):
                self.i += 1
                self.expression()
                if self.v[self.i - 1] != ")":
                    self.fail("expected a call before")
                return None
            if v == "if":
                return self.s_if()
            if v == "for":
                return self.s_for()
            if v == "switch":
                return self.s_switch()
            if v == "select":
                self.i += 1
                return self.clauses(lambda: self.simple())
            if v not in ("func", "struct", "map", "chan", "interface"):
                self.fail()
        if k == "n" and self.v[self.i + 1] == ":" and self.k[self.i + 1] == "p":
            self.i += 2
            return self.statement()
        self.simple()
        return None

    def simple(self, in_range: bool = False) -> str:
        """An expression, assignment, send or increment; returns what it was."""
        start = self.i
        self.expressions()
        v = self.v[self.i] if self.k[self.i] == "p" else ""
        if v in _ASSIGN:
            self.i += 1
            if in_range and self.take("range"):
                self.expression()
                return "range"
            if v not in ("=", ":="):
                self.expression()
            else:
                self.expressions()
            if v == ":=":
                for j in range(start, self.i):
                    if self.v[j] == ":=" and self.k[j] == "p":
                        break
                    if not (self.k[j] == "n" or (self.k[j] == "p" and self.v[j] == ",")):
                        self.fail("cannot declare before")
            return "assignment"
        if v in ("++", "--"):
            self.i += 1
            return "increment"
        if v == "<-":
            self.i += 1
            self.expression()
            return "send"
        if any(self.v[j] == "," and self.k[j] == "p" for j in self._tops(start, self.i)):
            self.fail("expected an assignment, not")
        return "expression"

    def _tops(self, a: int, b: int):
        while a < b:
            yield a
            a = self.t.match[a] + 1 if self.k[a] == "p" and a in self.t.match else a + 1

    def s_if(self) -> None:
        self.i += 1
        keep, self.level = self.level, -1
        if self.sign("{"):
            self.fail("expected a condition, not")
        what = "none"
        if not self.sign(";"):
            what = self.simple()
        if self.take(";"):
            what = self.simple()
        if what != "expression":
            self.fail("expected a condition before")
        self.level = keep
        self.block()
        if self.take("else"):
            if self.sign("if"):
                self.s_if()
            else:
                self.block()

    def s_for(self) -> None:
        self.i += 1
        keep, self.level = self.level, -1
        if not self.sign("{"):
            if self.take("range"):
                self.expression()
            else:
                what = "" if self.sign(";") else self.simple(True)
                if what != "range" and self.take(";"):
                    if not self.sign(";"):
                        self.simple()
                    self.need(";")
                    if not self.sign("{"):
                        self.simple()
        self.level = keep
        self.block()

    def s_switch(self) -> None:
        self.i += 1
        keep, self.level = self.level, -1
        if not self.sign("{"):
            if not self.sign(";"):
                self.simple()
            if self.take(";") and not self.sign("{"):
                self.simple()
        self.level = keep
        self.clauses(self.case_list)

    def case_list(self) -> None:
        self.case_entry()
        while self.take(","):
            self.case_entry()

    def case_entry(self) -> None:
        keep = self.i
        try:
            self.expression()
            if not (self.sign(",") or self.sign(":")):
                self.fail()
        except Invalid:
            self.i = keep
            self.type()

    def clauses(self, head) -> None:
        self.need("{")
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                head()
            self.need(":")
            self.statements()

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self) -> None:
        self.unary()
        while self.k[self.i] == "p" and self.v[self.i] in _BINARY:
            self.i += 1
            self.unary()

    def unary(self) -> None:
        while self.k[self.i] == "p" and self.v[self.i] in _UNARY:
            if self.v[self.i] == "<-" and self.v[self.i + 1] == "chan":
                self.type()
                break
            self.i += 1
        else:
            self.primary()
            return
        self.suffixes(True)

    def primary(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        literal = False
        if k in "ds":
            self.i += 1
        elif k == "n":
            self.i += 1
            literal = self.level >= 0
        elif k == "p" and v == "(":
            keep, self.level = self.level, self.level + 1 if self.level >= 0 else 0
            self.i += 1
            at = self.i
            try:
                self.expression()
                self.need(")")
            except Invalid as e:
                self.i = at
                try:
                    self.type()
                    self.need(")")
                except Invalid:
                    raise e from None
            self.level = keep
        elif k == "k" and v == "func":
            self.i += 1
            self.signature()
            if self.sign("{"):
                self.body()
        elif v == "[" or (k == "k" and v in ("struct", "map", "chan", "interface")):
            self.type()
            literal = True
            if not (self.sign("{") or self.sign("(") or self.sign(")") or self.sign(",") or self.sign("]")):
                self.fail()
        else:
            self.fail()
        self.suffixes(literal)

    def suffixes(self, literal: bool) -> None:
        while self.k[self.i] == "p":
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif v == "[":
                self.index()
            elif v == "(":
                keep, self.level = self.level, 0
                self.i += 1
                while not self.take(")"):
                    self.argument()
                    self.take("...")
                    if not self.sign(")"):
                        self.need(",")
                self.level = keep
                literal = False
            elif v == "{" and literal:
                self.composite()
                literal = False
            else:
                return

    def argument(self) -> None:
        keep = self.i
        try:
            self.expression()
            if not (self.sign(",") or self.sign(")") or self.sign("...")):
                self.fail()
        except Invalid as e:
            self.i = keep
            try:
                self.type()
            except Invalid:
                raise e from None

    def index(self) -> None:
        keep, self.level = self.level, 0
        self.need("[")
        colons = parts = 0
        if self.sign("]"):
            self.fail()
        while not self.take("]"):
            if self.take(":"):
                colons += 1
                continue
            if self.take(","):
                continue
            at = self.i
            try:
                self.expression()
                if not (self.sign(":") or self.sign("]") or self.sign(",")):
                    self.fail()
            except Invalid as e:
                self.i = at
                try:
                    self.type()
                except Invalid:
                    raise e from None
            parts += 1
        if colons > 2:
            self.fail()
        self.level = keep

    def composite(self) -> None:
        keep, self.level = self.level, 0
        self.need("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.sign("}"):
                self.need(",")
        self.level = keep

    def element(self) -> None:
        if self.sign("{"):
            self.composite()
        else:
            self.expression()


def check_go(text: str) -> None:
    Go(_lex(text)).file()
