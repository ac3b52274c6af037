"""Java."""

from __future__ import annotations

import re

from .base import Invalid, Tokens, Walk

_RESERVED = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split())
_PRIMITIVE = {"boolean", "byte", "char", "short", "int", "long", "float", "double"}
_MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default"}
_SPACE = re.compile(r"(?:\s+|//[^\n\r]*|/\*(?s:.*?)\*/)+")
_TOKEN = re.compile(
    r"(?P<n>[^\W\d][\w$]*|\$[\w$]*)|(?P<d>0[xX](?:[0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+[fFdD]?|[0-9a-fA-F](?:[0-9a-fA-F_]*[0-9a-fA-F])?[lL]?)|0[bB][01](?:[01_]*[01])?[lL]?|(?:\d(?:[\d_]*\d)?\.?(?:\d(?:[\d_]*\d)?)?|\.\d(?:[\d_]*\d)?)(?:[eE][+-]?\d+)?[fFdDlL]?)"
    r"|(?P<s>\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?s:(?:[^\\]|\\.)*?)\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.){1,2}')"
    r"|(?P<p>->|::|\.\.\.|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[-+*/%&|^!~?:=<>;,.()\[\]{}@])"
)
_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="}
_BINARY = {"+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", "<<"}


def _lex(text: str) -> Tokens:
    out, i, n = Tokens(), 0, len(text)
    space, token = _SPACE.match, _TOKEN.match
    while i < n:
        m = space(text, i)
        if m:
            i = m.end()
            if i >= n:
                break
        m = token(text, i)
        if not m:
            if text.startswith("/*", i):
                raise Invalid(f"comment at {i} is never closed")
            if text[i] == "\x1a" and i == n - 1:
                break
            raise Invalid(f"unexpected character {text[i]!r} at {i}")
        kind, value = m.lastgroup, m[0]
        if kind == "n" and value in _RESERVED:
            kind = "k"
        elif kind == "d" and m.end() < n and (text[m.end()].isalnum() or text[m.end()] in "_$"):
            raise Invalid(f"a name follows a number at {i}")
        elif kind == "s":
            value = '""'
        out.add(kind, value, False, i)
        i = m.end()
    out.end(n)
    return out


class Java(Walk):
    def unit(self) -> None:
        keep = self.i
        self.modifiers()
        if self.take("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = keep
        while self.k[self.i] != "e":
            if self.take(";"):
                continue
            if self.take("import"):
                self.take("static")
                self.name()
                while self.take("."):
                    if self.take("*"):
                        break
                    self.name()
                self.need(";")
                continue
            break
        while self.k[self.i] != "e":
            if self.take(";"):
                continue
            self.modifiers()
            if not self.type_declaration():
                if self.word("module") or self.word("open"):
                    return self.module()
                self.fail("expected a declaration, not")
        return None

    def module(self) -> None:
        if self.word("open"):
            self.i += 1
        self.i += 1
        self.qualified()
        self.need("{")
        self.i = self.t.match[self.i - 1] + 1
        if self.k[self.i] != "e":
            self.fail()

    def qualified(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def annotation(self) -> None:
        self.qualified()
        if self.take("("):
            while not self.take(")"):
                if self.k[self.i] == "n" and self.v[self.i + 1] == "=":
                    self.i += 2
                self.element()
                if not self.sign(")"):
                    self.need(",")

    def element(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                self.element()
                if not self.sign("}"):
                    self.need(",")
        elif self.sign("@"):
            self.i += 1
            self.annotation()
        else:
            self.expression()

    def modifiers(self) -> None:
        while True:
            if self.sign("@") and self.v[self.i + 1] != "interface":
                self.i += 1
                self.annotation()
            elif self.k[self.i] == "k" and self.v[self.i] in _MODIFIERS:
                if self.v[self.i] == "default" and self.v[self.i + 1] in (":", "->"):
                    return
                self.i += 1
            elif self.word("sealed") and (self.k[self.i + 1] == "k" or self.v[self.i + 1] in ("interface", "abstract")):
                self.i += 1
            elif self.word("non") and self.v[self.i + 1] == "-" and self.v[self.i + 2] == "sealed":
                self.i += 3
            else:
                return

    def type_declaration(self) -> bool:
        """A class, interface, enum, record or annotation type, if one comes next."""
        if self.take("class"):
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            self.heritage("implements")
            self.body()
        elif self.take("interface"):
            self.name()
            self.type_parameters()
            self.heritage("extends")
            self.body()
        elif self.take("enum"):
            self.name()
            self.heritage("implements")
            self.need("{")
            while not (self.sign(";") or self.sign("}")):
                self.modifiers()
                self.name()
                if self.sign("("):
                    self.arguments()
                if self.sign("{"):
                    self.body()
                if not self.take(","):
                    break
            if self.take(";"):
                while not self.sign("}"):
                    self.member()
            self.need("}")
        elif self.word("record") and self.k[self.i + 1] == "n" and self.v[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.heritage("implements")
            self.body()
        elif self.sign("@") and self.v[self.i + 1] == "interface":
            self.i += 2
            self.name()
            self.body()
        else:
            return False
        return True

    def heritage(self, word: str) -> None:
        if self.take(word):
            self.type()
            while self.take(","):
                self.type()
        if self.word("permits"):
            self.i += 1
            self.type()
            while self.take(","):
                self.type()

    def body(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return None
        if self.sign("{"):
            return self.block()
        if self.sign("static") and self.v[self.i + 1] == "{":
            self.i += 1
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_parameters()
        self.modifiers()
        if self.k[self.i] == "n" and self.v[self.i + 1] in ("(", "{"):
            self.i += 1
            if self.sign("("):
                self.parameters()
            self.throws()
            return self.block()
        if not self.take("void"):
            self.type()
        self.name()
        if self.sign("("):
            self.parameters()
            self.dimensions()
            self.throws()
            if self.take("default"):
                self.element()
            if self.sign("{"):
                return self.block()
            self.need(";")
            return None
        self.declarators()
        self.need(";")
        return None

    def throws(self) -> None:
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()

    def dimensions(self) -> None:
        while True:
            keep = self.i
            while self.sign("@"):
                self.i += 1
                self.annotation()
            if self.sign("[") and self.v[self.i + 1] == "]":
                self.i += 2
            else:
                self.i = keep
                return

    def declarators(self) -> None:
        """What follows the first name of a declaration."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.take("{"):
            while not self.take("}"):
                if self.take(","):
                    self.need("}")
                    return
                self.initializer()
                if not self.sign("}"):
                    self.need(",")
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.modifiers()
            self.type()
            if self.take("..."):
                pass
            if self.take("this"):
                pass
            else:
                self.name()
                if self.take("."):
                    self.need("this")
            self.dimensions()
            if not self.sign(")"):
                self.need(",")
                if self.sign(")"):
                    self.fail()

    # types

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.modifiers()
                self.name()
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def type(self) -> None:
        while self.sign("@"):
            self.i += 1
            self.annotation()
        if self.k[self.i] == "k" and self.v[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.sign(".") and (self.k[self.i + 1] == "n" or self.v[self.i + 1] == "@"):
                self.i += 1
                while self.sign("@"):
                    self.i += 1
                    self.annotation()
                self.name()
                self.type_arguments()
        self.dimensions()

    def type_arguments(self) -> None:
        if self.take("<"):
            if self.take(">"):
                return
            while True:
                while self.sign("@"):
                    self.i += 1
                    self.annotation()
                if self.take("?"):
                    if self.take("extends") or self.take("super"):
                        self.type()
                else:
                    self.type()
                if not self.take(","):
                    break
            self.need(">")

    def maybe_type(self) -> bool:
        keep = self.i
        try:
            self.type()
            return True
        except Invalid:
            self.i = keep
            return False

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def local(self) -> bool:
        """A local declaration's type and first name, if one comes next."""
        k = self.k[self.i]
        if k == "n" and self.k[self.i + 1] == "p" and self.v[self.i + 1] in ("(", "=", "++", "--", "+=", ";"):
            return False
        if k != "n" and not (k == "k" and self.v[self.i] in _PRIMITIVE):
            return False
        keep = self.i
        if self.maybe_type() and self.k[self.i] == "n" and self.v[self.i + 1] in ("=", ";", ",", ":", "["):
            self.i += 1
            return True
        self.i = keep
        return False

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.i += 1
                return None
        if k == "k":
            act = getattr(self, f"s_{v}", None)
            if act and not (v == "switch" and False):
                self.i += 1
                return act()
        if k == "n":
            if self.v[self.i + 1] == ":" and self.k[self.i + 1] == "p":
                self.i += 2
                return self.statement()
            if v == "yield" and self.k[self.i + 1] in "ndsk" and not (self.k[self.i + 1] == "k" and self.v[self.i + 1] == "instanceof"):
                self.i += 1
                self.expression()
                return self.need(";")
        keep = self.i
        self.modifiers()
        moved = self.i > keep
        if self.type_declaration():
            return None
        if self.local():
            self.declarators()
            return self.need(";")
        if moved:
            self.fail()
        start = self.i
        self.expression()
        if self.v[self.i - 1] != ")" and self.v[self.i - 1] not in ("++", "--") and self.v[start] not in ("++", "--", "new", "switch") and not self.assigned:
            self.fail("not a statement before")
        return self.need(";")

    def s_if(self) -> None:
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_while(self) -> None:
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        keep = self.i
        self.modifiers()
        if self.local():
            if self.take(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        else:
            self.i = keep
            if not self.sign(";"):
                self.expressions()
        self.need(";")
        if not self.sign(";"):
            self.expression()
        self.need(";")
        if not self.sign(")"):
            self.expressions()
        self.need(")")
        return self.statement()

    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def s_return(self) -> None:
        if not self.sign(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.expression()
        self.need(";")

    def s_break(self) -> None:
        if self.k[self.i] == "n":
            self.i += 1
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.paren()
        self.block()

    def s_try(self) -> None:
        some = False
        if self.take("("):
            some = True
            while not self.take(")"):
                self.modifiers()
                if self.local():
                    self.need("=")
                self.expression()
                if not self.sign(")"):
                    self.need(";")
        self.block()
        while self.take("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not some:
            self.fail("expected catch or finally, not")

    def s_switch(self) -> None:
        self.switch()

    def switch(self) -> None:
        self.paren()
        self.need("{")
        while not self.take("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    self.case_label()
                    if not self.take(","):
                        break
                if self.word("when"):
                    self.i += 1
                    self.binary()
            if self.take("->"):
                if self.sign("{"):
                    self.block()
                elif self.sign("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not (self.sign("}") or self.sign("case") or (self.sign("default") and self.v[self.i + 1] in (":", "->"))):
                    self.statement()

    def case_label(self) -> None:
        if self.take("default"):
            return
        keep = self.i
        if not self.pattern():
            self.i = keep
            self.ternary()

    def pattern(self) -> bool:
        keep = self.i
        self.modifiers()
        if self.maybe_type():
            if self.sign("("):
                try:
                    self.i += 1
                    while not self.take(")"):
                        if not self.pattern():
                            raise Invalid("no pattern")
                        if not self.sign(")"):
                            self.need(",")
                    if self.k[self.i] == "n" and self.v[self.i] != "when":
                        self.i += 1
                    return True
                except Invalid:
                    self.i = keep
                    return False
            if self.k[self.i] == "n" and not (self.v[self.i] == "when"):
                self.i += 1
                return True
        self.i = keep
        return False

    # expressions

    assigned = False

    def expression(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "n" and self.v[self.i + 1] == "->":
            self.i += 2
            return self.lambda_body()
        if k == "p" and v == "(" and self.v[self.t.match[self.i] + 1] == "->":
            end = self.t.match[self.i]
            if self.k[self.i + 1] == "n" and self.v[self.i + 2] in (",", ")"):
                self.i += 1
                self.name()
                while self.take(","):
                    self.name()
                self.need(")")
            else:
                self.parameters()
            if self.i != end + 1:
                self.fail()
            self.need("->")
            return self.lambda_body()
        self.ternary()
        self.assigned = False
        v = self.v[self.i]
        if self.k[self.i] == "p":
            if v in _ASSIGN:
                self.i += 1
            elif v == ">" and self._shift().endswith("="):
                self.i += len(self._shift()) - 1
            else:
                return None
            self.expression()
            self.assigned = True
        return None

    def lambda_body(self) -> None:
        if self.sign("{"):
            self.block()
        else:
            self.expression()

    def _shift(self) -> str:
        out, j = ">", self.i + 1
        while len(out) < 3 and self.v[j] == ">" and self.t.place[j] == self.t.place[j - 1] + 1:
            out += ">"
            j += 1
        if len(out) > 1 and self.v[j] == ">=" and self.t.place[j] == self.t.place[j - 1] + 1 or (len(out) == 1 and self.v[j] == ">=" and self.t.place[j] == self.t.place[j - 1] + 1):
            out += ">="
        return out

    def ternary(self) -> None:
        self.binary()
        if self.take("?"):
            self.expression()
            self.need(":")
            if self.v[self.i + 1] == "->" or (self.sign("(") and self.v[self.t.match[self.i] + 1] == "->"):
                self.expression()
            else:
                self.ternary()

    def binary(self) -> None:
        self.unary()
        while True:
            k, v = self.k[self.i], self.v[self.i]
            if k == "p" and v in _BINARY:
                if v == ">":
                    s = self._shift()
                    if s.endswith("="):
                        return
                    self.i += len(s)
                else:
                    self.i += 1
                self.unary()
            elif k == "k" and v == "instanceof":
                self.i += 1
                self.modifiers()
                if not self.pattern():
                    self.type()
            else:
                return

    def unary(self) -> None:
        v = self.v[self.i]
        if self.k[self.i] == "p":
            if v in ("+", "-", "!", "~", "++", "--"):
                self.i += 1
                return self.unary()
            if v == "(" and self.cast():
                return None
        self.primary()
        while self.sign("++") or self.sign("--"):
            self.i += 1
        return None

    def cast(self) -> bool:
        keep, end = self.i, self.t.match[self.i]
        primitive = self.v[self.i + 1] in _PRIMITIVE and self.k[self.i + 1] == "k"
        self.i += 1
        try:
            self.type()
            while self.take("&"):
                self.type()
        except Invalid:
            self.i = keep
            return False
        if self.i != end:
            self.i = keep
            return False
        nk, nv = self.k[end + 1], self.v[end + 1]
        if primitive and self.v[end - 1] != "]" or nk in "nds" or (nk == "k" and nv not in ("instanceof",)) or nv in ("(", "!", "~"):
            if primitive and nv in (".", "::"):
                self.i = keep
                return False
            self.i = end + 1
            if self.v[self.i + 1] == "->" or (self.sign("(") and self.v[self.t.match[self.i] + 1] == "->"):
                self.expression()
            else:
                self.unary()
            return True
        self.i = keep
        return False

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        self.expressions()
        self.need(")")

    def primary(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k in "ds":
            self.i += 1
        elif k == "n":
            keep = self.i
            self.i += 1
            if self.sign("(") or self.sign("."):
                if self.sign("("):
                    self.arguments()
            elif self.sign("[") and self.v[self.i + 1] == "]" or self.sign("<") or self.sign("@"):
                self.i = keep
                if not (self.maybe_type() and (self.sign("::") or (self.sign(".") and self.v[self.i + 1] == "class"))):
                    self.i = keep + 1
        elif k == "k":
            if v in ("this", "super"):
                self.i += 1
                if self.sign("("):
                    self.arguments()
                elif v == "super" and not (self.sign(".") or self.sign("::")):
                    self.fail()
            elif v in ("true", "false", "null"):
                self.i += 1
            elif v == "new":
                self.i += 1
                self.creator()
            elif v == "switch":
                self.i += 1
                self.switch()
            elif v in _PRIMITIVE or v == "void":
                self.i += 1
                self.dimensions()
                if self.sign("."):
                    self.i += 1
                    self.need("class")
                elif not self.sign("::"):
                    self.fail()
            else:
                self.fail()
        elif v == "(":
            self.i += 1
            self.expression()
            self.need(")")
        else:
            self.fail()
        self.suffixes()

    def suffixes(self) -> None:
        while True:
            if self.take("."):
                if self.sign("<"):
                    self.type_arguments()
                if self.take("new"):
                    self.creator()
                elif self.take("class") or self.take("this"):
                    pass
                elif self.take("super"):
                    if self.sign("("):
                        self.arguments()
                else:
                    self.name()
                    if self.sign("("):
                        self.arguments()
                    elif self.sign("<") or (self.sign("[") and self.v[self.i + 1] == "]"):
                        keep = self.i
                        try:
                            self.type_arguments()
                            self.dimensions()
                            if not (self.sign("::") or (self.sign(".") and self.v[self.i + 1] in ("class",))):
                                raise Invalid("no type")
                        except Invalid:
                            self.i = keep
                            if self.sign("["):
                                self.fail()
            elif self.sign("[") and self.v[self.i + 1] != "]":
                self.i += 1
                self.expression()
                self.need("]")
            elif self.take("::"):
                if self.sign("<"):
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
            else:
                return

    def creator(self) -> None:
        if self.sign("<"):
            self.type_arguments()
        while self.sign("@"):
            self.i += 1
            self.annotation()
        if self.k[self.i] == "k" and self.v[self.i] in _PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.take("."):
                self.name()
                self.type_arguments()
        if self.sign("["):
            if self.v[self.i + 1] == "]":
                self.dimensions()
                if not self.sign("{"):
                    self.fail()
                self.initializer()
                return
            while self.sign("[") and self.v[self.i + 1] != "]":
                self.i += 1
                self.expression()
                self.need("]")
            self.dimensions()
            return
        self.arguments()
        if self.sign("{"):
            self.body()


def check_java(text: str) -> None:
    Java(_lex(text)).unit()
