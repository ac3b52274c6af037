"""JavaScript modules and TypeScript."""

from __future__ import annotations

import re

from .base import Invalid, Tokens, Walk

_RESERVED = set("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_SPACE = re.compile(r"(?:[ \t\v\f ﻿  -   　]+|//[^\n\r  ]*|(?P<nl>[\n\r  ]+)|(?P<block>/\*(?s:.*?)\*/))")
_NAME = r"(?:[$_]|[^\W\d]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[$‌‍\w]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*"
_TOKEN = re.compile(
    rf"(?P<n>#?{_NAME})|(?P<d>0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?n?)"
    r"|(?P<s>\"(?:[^\"\\\r\n]|\\(?:\r\n|(?s:.)))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|(?s:.)))*')"
    r"|(?P<p>=>|\.\.\.|\*\*=|\*\*|===|!==|==|!=|<<=|<<|<=|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|[-+*%&|^!~?:=<>;,.()\[\]{}@])"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_PART = re.compile(r"[^\W]|[$_\\]")
_VALUE_ENDS = {")", "]", "}"}


def _template(text: str, at: int, ts: bool) -> int:
    """The end of the template literal that begins at ``at``; its expressions are checked."""
    i = at + 1
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1
        elif c == "$" and text[i + 1 : i + 2] == "{":
            tokens = Tokens()
            i = _lex(text, tokens, i + 2, ts, True)
            walk = Script(tokens, ts)
            walk.expression()
            if walk.k[walk.i] != "e":
                walk.fail()
        else:
            i += 1
    raise Invalid(f"template at {at} is never closed")


def _lex(text: str, out: Tokens, i: int, ts: bool, inner: bool = False) -> int:
    n, fresh, depth = len(text), False, 0
    space, token = _SPACE.match, _TOKEN.match
    while i < n:
        m = space(text, i)
        if m:
            if m["nl"] is not None or (m["block"] and ("\n" in m[0] or "\r" in m[0])):
                fresh = True
            i = m.end()
            continue
        m = token(text, i)
        if m:
            kind, value = m.lastgroup, m[0]
            if inner and kind == "p":
                if value == "{":
                    depth += 1
                elif value == "}":
                    if not depth:
                        out.end(i)
                        return i + 1
                    depth -= 1
            if kind == "n":
                if value in _RESERVED:
                    kind = "k"
            elif kind == "d" and m.end() < n and _PART.match(text, m.end()):
                raise Invalid(f"a name follows a number at {i}")
            elif kind == "p" and value == ">" and not ts:
                m2 = re.compile(r">>>=|>>=|>>>|>>|>=|>").match(text, i)
                value, m = m2[0], m2
            elif kind == "p" and value == ">" and text[i + 1 : i + 2] == "=":
                value = ">="
                out.add("p", value, fresh, i)
                fresh, i = False, i + 2
                continue
            out.add(kind, value, fresh, i)
            fresh, i = False, m.end()
            continue
        c = text[i]
        if c == "`":
            end = _template(text, i, ts)
            out.add("s", "``", fresh, i)
            fresh, i = False, end
        elif c == "/":
            k, v = (out.kind[-1], out.value[-1]) if out.kind else ("", "")
            value_before = k in ("n", "d", "s", "r") or (k == "k" and v in ("this", "super", "null", "true", "false")) or (k == "p" and v in _VALUE_ENDS)
            if v == ")" and k == "p":  # after the head of a statement a value begins
                at = out.opener[len(out.value) - 1]
                value_before = not (at and out.kind[at - 1] == "k" and out.value[at - 1] in ("if", "while", "for", "with"))
            m = None if value_before and v != "}" else _REGEX.match(text, i)
            if m:
                out.add("r", m[0], fresh, i)
                fresh, i = False, m.end()
            else:
                if text.startswith("/*", i):
                    raise Invalid(f"comment at {i} is never closed")
                size = 2 if text[i + 1 : i + 2] == "=" else 1
                out.add("p", text[i : i + size], fresh, i)
                fresh, i = False, i + size
        else:
            raise Invalid(f"unexpected character {c!r} at {i}")
    if inner:
        raise Invalid("template expression is never closed")
    out.end(n)
    return n


_ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
_BINARY = {"+", "-", "*", "/", "%", "**", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "<<", ">>", ">>>", "&", "|", "^", "&&", "||", "??"}
_PREFIX = {"+", "-", "!", "~", "++", "--"}
_PREFIX_WORDS = {"typeof", "void", "delete"}
_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "override", "declare", "async", "accessor", "get", "set"}


class Script(Walk):
    def __init__(self, tokens: Tokens, ts: bool) -> None:
        super().__init__(tokens)
        self.ts = ts

    # statements

    def program(self) -> None:
        while self.k[self.i] != "e":
            self.statement()

    def semicolon(self) -> None:
        if self.take(";") or self.sign("}") or self.k[self.i] == "e" or self.t.fresh[self.i]:
            return
        self.fail("expected ';' before")

    def block(self) -> None:
        self.need("{")
        while not self.sign("}"):
            self.statement()
        self.i += 1

    def statement(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "e":
            self.fail()
        if k == "p":
            if v == "{":
                return self.block()
            if v == ";":
                self.i += 1
                return None
            if v == "@":
                self.decorators()
                if not (self.word("class") or self.word("export") or self.word("abstract")):
                    self.fail()
                return self.statement()
        elif k == "k":
            act = getattr(self, f"s_{v}", None)
            if act and not (v == "import" and self.v[self.i + 1] in ("(", ".")):
                self.i += 1
                return act()
            if v in ("else", "case", "default", "catch", "finally", "extends", "in", "instanceof", "enum", "with"):
                self.fail()
        elif k == "n":
            nk, nv, same = self.k[self.i + 1], self.v[self.i + 1], not self.t.fresh[self.i + 1]
            if nv == ":" and nk == "p":
                self.i += 2
                return self.statement()
            if v == "async" and nv == "function" and same:
                self.i += 2
                return self.function(True)
            if v == "let" and (nk == "n" or nv in ("[", "{")):
                self.i += 1
                self.declarations()
                return self.semicolon()
            if self.ts and same:
                if v == "interface" and nk == "n":
                    self.i += 2
                    self.generics()
                    if self.take("extends"):
                        self.type_list()
                    return self.object_type()
                if v == "type" and nk == "n":
                    self.i += 2
                    self.generics()
                    self.need("=")
                    self.type()
                    return self.semicolon()
                if v in ("namespace", "module") and nk in ("n", "s"):
                    self.i += 2
                    while self.take("."):
                        self.name()
                    return self.block() if self.sign("{") else self.semicolon()
                if v == "global" and nv == "{":
                    self.i += 1
                    return self.block()
                if v in ("declare", "abstract") and (nk == "n" or nv in ("class", "function", "const", "var", "enum")):
                    self.i += 1
                    return self.statement()
        self.expression()
        return self.semicolon()

    def s_var(self) -> None:
        self.declarations()
        self.semicolon()

    def s_const(self) -> None:
        if self.ts and self.take("enum"):
            return self.enum()
        self.declarations()
        return self.semicolon()

    def s_enum(self) -> None:
        if not self.ts:
            self.fail()
        self.enum()

    def enum(self) -> None:
        self.name()
        self.need("{")
        while not self.take("}"):
            self.property_name()
            if self.take("="):
                self.assign()
            if not self.sign("}"):
                self.need(",")

    def s_function(self) -> None:
        self.function(True)

    def s_class(self) -> None:
        self.cls(True)

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

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
        self.take(";")

    def s_for(self) -> None:
        if self.word("await"):
            self.i += 1
        self.need("(")
        if not self.take(";"):
            if self.v[self.i] in ("var", "const") or (self.v[self.i] == "let" and self.k[self.i + 1] in "np"):
                self.i += 1
                self.declarations(True)
            elif not self.sign(";"):
                self.expression(True)
            if self.word("of") or self.word("in"):
                self.i += 1
                self.expression()
                self.need(")")
                return self.statement()
            self.need(";")
        if not self.sign(";"):
            self.expression()
        self.need(";")
        if not self.sign(")"):
            self.expression()
        self.need(")")
        return self.statement()

    def s_return(self) -> None:
        if not (self.sign(";") or self.sign("}") or self.t.fresh[self.i]):
            self.expression()
        self.semicolon()

    def s_throw(self) -> None:
        if self.t.fresh[self.i]:
            self.fail("line break after throw before")
        self.expression()
        self.semicolon()

    def s_break(self) -> None:
        if self.k[self.i] == "n" and not self.t.fresh[self.i]:
            self.i += 1
        self.semicolon()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.semicolon()

    def s_try(self) -> None:
        self.block()
        some = False
        if self.take("catch"):
            some = True
            if self.take("("):
                self.binding()
                if self.ts and self.take(":"):
                    self.type()
                self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not some:
            self.fail("expected catch or finally, not")

    def s_switch(self) -> None:
        self.paren()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not (self.sign("}") or self.sign("case") or self.sign("default")):
                self.statement()

    def module_name(self) -> None:
        if self.k[self.i] in "nks":
            self.i += 1
        else:
            self.fail("expected a name, not")

    def named(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.ts and self.word("type") and self.k[self.i + 1] in "nk" and not self.v[self.i + 1] == "as":
                self.i += 1
            self.module_name()
            if self.word("as"):
                self.i += 1
                self.module_name()
            if not self.sign("}"):
                self.need(",")

    def source(self) -> None:
        if not self.word("from"):
            self.fail("expected from, not")
        self.i += 1
        self.string()
        if self.word("with") or self.word("assert"):
            self.i += 1
            self.primary()

    def string(self) -> None:
        if self.k[self.i] != "s":
            self.fail("expected a string, not")
        self.i += 1

    def s_import(self) -> None:
        if self.k[self.i] == "s":
            self.i += 1
            return self.semicolon()
        if self.ts and self.word("type") and (self.k[self.i + 1] == "n" and self.v[self.i + 1] != "from" or self.v[self.i + 1] in ("{", "*")):
            self.i += 1
        if self.k[self.i] == "n":
            self.i += 1
            if self.ts and self.take("="):
                self.expression()
                return self.semicolon()
            if not self.take(","):
                self.source()
                return self.semicolon()
        if self.take("*"):
            if not self.word("as"):
                self.fail()
            self.i += 1
            self.name()
        else:
            self.named()
        self.source()
        return self.semicolon()

    def s_export(self) -> None:
        if self.take("default"):
            if self.word("abstract") and self.v[self.i + 1] == "class":
                self.i += 1
            if self.sign("@"):
                self.decorators()
            if self.take("function"):
                return self.function(False, True)
            if self.take("class"):
                return self.cls(False)
            if self.word("async") and self.v[self.i + 1] == "function" and not self.t.fresh[self.i + 1]:
                self.i += 2
                return self.function(False, True)
            if self.ts and self.word("interface") and self.k[self.i + 1] == "n":
                return self.statement()
            self.assign()
            return self.semicolon()
        if self.ts and self.word("type") and self.v[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.word("as"):
                self.i += 1
                self.module_name()
            self.source()
            return self.semicolon()
        if self.sign("{"):
            self.named()
            if self.word("from"):
                self.source()
            return self.semicolon()
        if self.ts and (self.take("=") or (self.word("as") and self.v[self.i + 1] == "namespace")):
            if self.word("as"):
                self.i += 2
            self.expression()
            return self.semicolon()
        v = self.v[self.i]
        if not (v in ("var", "const", "function", "class", "let", "async", "@") or (self.ts and v in ("interface", "type", "enum", "namespace", "declare", "abstract", "module", "import"))):
            self.fail()
        return self.statement()

    # declarations

    def binding(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.binding()
                if self.take("="):
                    self.assign()
                if not self.sign("]"):
                    self.need(",")
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.name()
                else:
                    plain = self.k[self.i] == "n"
                    self.property_name()
                    if self.take(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.take("="):
                        self.assign()
                if not self.sign("}"):
                    self.need(",")
        else:
            self.name()

    def declarations(self, in_for: bool = False) -> None:
        while True:
            self.binding()
            if self.ts:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assign(in_for)
            if not self.take(","):
                return

    def decorators(self) -> None:
        while self.take("@"):
            if self.sign("("):
                self.paren()
            else:
                self.name()
                while self.take("."):
                    self.module_name()
                if self.sign("("):
                    self.arguments()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            if self.sign("@"):
                self.decorators()
            if self.ts:
                while self.v[self.i] in ("public", "private", "protected", "readonly", "override") and (self.k[self.i + 1] == "n" or self.v[self.i + 1] in ("{", "[")):
                    self.i += 1
            rest = self.take("...")
            if self.ts and self.take("this"):
                pass
            else:
                self.binding()
            if self.ts:
                self.take("?")
                if self.take(":"):
                    self.type()
            if not rest and self.take("="):
                self.assign()
            if not self.sign(")"):
                self.need(",")

    def returns(self) -> None:
        if self.ts and self.take(":"):
            self.return_type()

    def function(self, declared: bool, default: bool = False) -> None:
        self.take("*")
        if self.k[self.i] == "n":
            self.i += 1
        elif declared:
            self.fail("expected a name, not")
        self.generics()
        self.parameters()
        self.returns()
        if self.sign("{"):
            self.block()
        elif self.ts and (declared or default):
            self.semicolon()
        else:
            self.fail()

    def cls(self, declared: bool) -> None:
        if self.k[self.i] == "n" and not (self.word("implements") and not declared):
            self.i += 1
        elif declared:
            self.fail("expected a name, not")
        self.generics()
        if self.take("extends"):
            self.unary()
            if self.ts and self.sign("<"):
                self.type_arguments()
        if self.ts and self.word("implements"):
            self.i += 1
            self.type_list()
        self.need("{")
        while not self.take("}"):
            if not self.take(";"):
                self.member()

    def member(self) -> None:
        if self.sign("@"):
            self.decorators()
        if self.word("static") and self.v[self.i + 1] == "{":
            self.i += 1
            return self.block()
        words = _MODIFIERS if self.ts else {"static", "async", "get", "set", "accessor"}
        while self.v[self.i] in words and self.k[self.i] in "nk" and not (self.k[self.i + 1] == "p" and self.v[self.i + 1] in ("(", "=", ";", "}", ":", "?", "!", "<", ",")):
            self.i += 1
        self.take("*")
        if self.ts and self.sign("[") and self.k[self.i + 1] == "n" and self.v[self.i + 2] == ":":
            self.i += 3
            self.type()
            self.need("]")
            if self.take(":"):
                self.type()
            return self.semicolon()
        self.property_name()
        if self.ts:
            self.take("?") or self.take("!")
        if self.sign("(") or self.sign("<"):
            self.generics()
            self.parameters()
            self.returns()
            if self.sign("{"):
                return self.block()
            if self.ts:
                return self.semicolon()
            self.fail()
        if self.ts and self.take(":"):
            self.type()
        if self.take("="):
            self.assign()
        return self.semicolon()

    def property_name(self) -> None:
        if self.k[self.i] in "nksd":
            self.i += 1
        elif self.take("["):
            self.assign()
            self.need("]")
        else:
            self.fail("expected a name, not")

    # expressions

    def expression(self, in_for: bool = False) -> None:
        self.assign(in_for)
        while self.take(","):
            self.assign(in_for)

    def arrow_at(self) -> bool:
        """Whether an arrow function begins at the parenthesis that comes next."""
        end = self.t.match[self.i]
        if self.v[end + 1] == "=>":
            return True
        if not (self.ts and self.v[end + 1] == ":" and self.k[end + 1] == "p"):
            return False
        keep = self.i
        try:
            self.i = end + 2
            self.return_type()
            return self.sign("=>")
        except Invalid:
            return False
        finally:
            self.i = keep

    def arrow_rest(self, in_for: bool) -> None:
        if self.t.fresh[self.i]:
            self.fail("line break before")
        self.need("=>")
        if self.sign("{"):
            self.block()
        else:
            self.assign(in_for)

    def assign(self, in_for: bool = False) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k == "n":
            nv = self.v[self.i + 1]
            if nv == "=>":
                self.i += 1
                return self.arrow_rest(in_for)
            if v == "async" and not self.t.fresh[self.i + 1]:
                if self.k[self.i + 1] == "n" and self.v[self.i + 2] == "=>":
                    self.i += 2
                    return self.arrow_rest(in_for)
                if nv in ("(", "<"):
                    keep = self.i
                    self.i += 1
                    if (nv == "(" and self.arrow_at()) or (nv == "<" and self.ts):
                        try:
                            self.generics()
                            self.parameters()
                            self.returns()
                            return self.arrow_rest(in_for)
                        except Invalid:
                            if nv == "(":
                                raise
                    self.i = keep
            if v == "yield" and not (self.k[self.i + 1] == "p" and nv in (")", "]", "}", ",", ";", ":", "=", ".")):
                self.i += 1
                if not self.t.fresh[self.i]:
                    self.take("*")
                    return self.assign(in_for)
                return None
        elif v == "(" and k == "p" and self.arrow_at():
            self.parameters()
            self.returns()
            return self.arrow_rest(in_for)
        elif v == "<" and self.ts and k == "p":
            keep = self.i
            try:
                self.generics()
                self.parameters()
                self.returns()
                return self.arrow_rest(in_for)
            except Invalid:
                self.i = keep
                self.type_arguments()
                return self.unary()
        start = self.i
        simple = self.binary(in_for)
        if self.k[self.i] == "p" and self.v[self.i] in _ASSIGN or (self.ts and self.sign(">") and self._shift() in (">>=", ">>>=")):
            if not simple:
                self.fail("cannot assign before")
            if self.v[start] in ("{", "[") and self.v[self.i] != "=":
                self.fail()
            self.i += len(self._shift()) - 1 if self.sign(">") else 1
            return self.assign(in_for)
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign(in_for)
        return None

    def _shift(self) -> str:
        """The signs of a shift, which TypeScript's tokens hold one by one."""
        out, j = ">", self.i + 1
        while len(out) < 3 and self.v[j] == ">" and self.t.place[j] == self.t.place[j - 1] + 1:
            out += ">"
            j += 1
        if self.v[j] == ">=" and self.t.place[j] == self.t.place[j - 1] + 1:
            out += ">="
        return out

    def binary(self, in_for: bool) -> bool:
        """Returns whether the expression is one that can be assigned to."""
        simple = self.unary()
        while True:
            k, v = self.k[self.i], self.v[self.i]
            if k == "p" and v in _BINARY:
                if v == ">" and self.ts:
                    s = self._shift()
                    if s.endswith("="):
                        if len(s) > 2:
                            return simple
                    self.i += len(s)
                else:
                    self.i += 1
            elif k == "k" and (v == "instanceof" or (v == "in" and not in_for)):
                self.i += 1
            elif k == "n" and self.ts and v in ("as", "satisfies") and not self.t.fresh[self.i]:
                self.i += 1
                if self.v[self.i] == "const":
                    self.i += 1
                else:
                    self.type()
                continue
            else:
                return simple
            self.unary()
            simple = False

    def unary(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        if k == "p" and v in _PREFIX or k == "k" and v in _PREFIX_WORDS:
            self.i += 1
            self.unary()
            return False
        if k == "n" and v == "await" and not (self.k[self.i + 1] == "p" and self.v[self.i + 1] in (")", "]", "}", ",", ";", ":", "=", ".", "=>", "?", "&&", "||")):
            self.i += 1
            self.unary()
            return False
        if k == "p" and v == "<" and self.ts:
            self.type_arguments()
            self.unary()
            return False
        simple = self.postfix()
        if self.k[self.i] == "p" and self.v[self.i] in ("++", "--") and not self.t.fresh[self.i]:
            if not simple:
                self.fail()
            self.i += 1
            return False
        return simple

    def arguments(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.take("...")
            self.assign()
            if not self.sign(")"):
                self.need(",")

    def postfix(self) -> bool:
        simple = self.primary()
        while True:
            if self.k[self.i] == "s" and self.v[self.i] == "``":
                self.i += 1
                simple = False
                continue
            if self.k[self.i] != "p":
                return simple
            v = self.v[self.i]
            if v == ".":
                self.i += 1
                self.module_member()
                simple = True
            elif v == "?.":
                self.i += 1
                if self.sign("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                else:
                    self.module_member()
                simple = False
            elif v == "[":
                self.i += 1
                self.expression()
                self.need("]")
                simple = True
            elif v == "(":
                self.arguments()
                simple = False
            elif v == "!" and self.ts and not self.t.fresh[self.i] and not (self.v[self.i + 1] == "=" and self.t.place[self.i + 1] == self.t.place[self.i] + 1):
                self.i += 1
            elif v == "<" and self.ts and self._call_types():
                simple = False
            else:
                return simple

    def _call_types(self) -> bool:
        keep = self.i
        try:
            self.type_arguments()
        except Invalid:
            self.i = keep
            return False
        if self.v[self.i] in ("(", "``") or (self.k[self.i] == "p" and self.v[self.i] in (")", "]", ",", ";", ":", "}")) or self.k[self.i] == "e":
            return True
        self.i = keep
        return False

    def module_member(self) -> None:
        if self.k[self.i] not in "nk":
            self.fail("expected a name, not")
        self.i += 1

    def primary(self) -> bool:
        k, v = self.k[self.i], self.v[self.i]
        if k in "ds" or k == "r":
            self.i += 1
            return False
        if k == "n":
            if v == "async" and self.v[self.i + 1] == "function" and not self.t.fresh[self.i + 1]:
                self.i += 2
                self.function(False)
                return False
            self.i += 1
            if v[0] == "#" and not self.sign("in"):
                self.fail()
            return True
        if k == "k":
            if v in ("this", "null", "true", "false"):
                self.i += 1
                return False
            if v == "super":
                self.i += 1
                if self.v[self.i] not in ("(", ".", "["):
                    self.fail()
                return False
            if v == "function":
                self.i += 1
                self.function(False)
                return False
            if v == "class":
                self.i += 1
                self.cls(False)
                return False
            if v == "new":
                self.i += 1
                if self.take("."):
                    self.name()
                    return False
                self.new_target()
                if self.ts and self.sign("<"):
                    self.type_arguments()
                if self.sign("("):
                    self.arguments()
                return False
            if v == "import" and self.v[self.i + 1] in ("(", "."):
                self.i += 1
                if self.take("."):
                    self.name()
                return False
            self.fail()
        if v == "(":
            self.i += 1
            self.expression()
            self.need(")")
            return True
        if v == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assign()
                if not self.sign("]"):
                    self.need(",")
            return True
        if v == "{":
            self.i += 1
            self.object()
            return True
        if v == "@":
            self.decorators()
            self.need("class")
            self.cls(False)
            return False
        self.fail()
        return False

    def new_target(self) -> None:
        self.primary()
        while True:
            if self.take("."):
                self.module_member()
            elif self.take("["):
                self.expression()
                self.need("]")
            else:
                return

    def object(self) -> None:
        while not self.take("}"):
            if self.take("..."):
                self.assign()
            else:
                while self.v[self.i] in ("get", "set", "async") and self.k[self.i] == "n" and not (self.k[self.i + 1] == "p" and self.v[self.i + 1] in ("(", ":", ",", "}", "=")):
                    self.i += 1
                self.take("*")
                plain = self.k[self.i] == "n"
                self.property_name()
                if self.take(":"):
                    self.assign()
                elif self.sign("(") or (self.ts and self.sign("<")):
                    self.generics()
                    self.parameters()
                    self.returns()
                    self.block()
                elif not plain:
                    self.fail()
                elif self.take("="):
                    self.assign()
            if not self.sign("}"):
                self.need(",")

    # types

    def generics(self) -> None:
        if not (self.ts and self.take("<")):
            return
        while not self.take(">"):
            while self.v[self.i] in ("const", "in", "out") and self.k[self.i + 1] == "n":
                self.i += 1
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.sign(">"):
                self.need(",")

    def type_arguments(self) -> None:
        self.need("<")
        while not self.take(">"):
            self.type()
            if not self.sign(">"):
                self.need(",")

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def return_type(self) -> None:
        if self.word("asserts") and self.k[self.i + 1] in "nk" and not self.t.fresh[self.i + 1]:
            self.i += 2
            if self.word("is"):
                self.i += 1
                self.type()
            return
        if self.k[self.i] in "nk" and self.v[self.i + 1] == "is" and self.k[self.i + 1] == "n" and not self.t.fresh[self.i + 1]:
            self.i += 2
        self.type()

    def type(self) -> None:
        self.union()
        if self.sign("extends") and not self.t.fresh[self.i]:
            self.i += 1
            self.union()
            self.need("?")
            self.type()
            self.need(":")
            self.type()

    def union(self) -> None:
        self.take("|") or self.take("&")
        self.type_unary()
        while self.take("|") or self.take("&"):
            self.type_unary()

    def type_unary(self) -> None:
        if self.v[self.i] in ("keyof", "readonly", "unique", "infer") and self.k[self.i] == "n" and (self.k[self.i + 1] in "nks" or self.v[self.i + 1] in ("(", "[", "{")):
            infer = self.v[self.i] == "infer"
            self.i += 1
            self.type_unary()
            if infer and self.sign("extends"):
                keep = self.i
                self.i += 1
                try:
                    self.union()
                    if self.sign("?"):
                        self.i = keep
                except Invalid:
                    self.i = keep
            return
        self.type_primary()
        while not self.t.fresh[self.i] and self.sign("["):
            self.i += 1
            if not self.take("]"):
                self.type()
                self.need("]")

    def type_primary(self) -> None:
        k, v = self.k[self.i], self.v[self.i]
        if k in "sd":
            self.i += 1
        elif k == "p" and v == "-":
            self.i += 1
            if self.k[self.i] != "d":
                self.fail()
            self.i += 1
        elif v == "new" or (v == "abstract" and self.v[self.i + 1] == "new"):
            self.i += 1 + (v == "abstract")
            self.generics()
            self.parameters()
            self.need("=>")
            self.return_type()
        elif v == "typeof" and k == "k":
            self.i += 1
            if not self.take("import"):
                self.module_member()
            else:
                self.arguments()
            while self.take("."):
                self.module_member()
            if self.sign("<"):
                self.type_arguments()
        elif v == "import" and k == "k":
            self.i += 1
            self.arguments()
            while self.take("."):
                self.module_member()
            if self.sign("<"):
                self.type_arguments()
        elif k == "n" or (k == "k" and v in ("this", "null", "void", "true", "false")):
            self.i += 1
            while self.take("."):
                self.module_member()
            if self.sign("<") and not self.t.fresh[self.i]:
                self.type_arguments()
        elif v == "{":
            self.object_type()
        elif v == "[":
            self.i += 1
            while not self.take("]"):
                self.take("...")
                if self.k[self.i] == "n" and (self.v[self.i + 1] == ":" or (self.v[self.i + 1] == "?" and self.v[self.i + 2] == ":")):
                    self.i += 1
                    self.take("?")
                    self.i += 1
                self.type()
                self.take("?")
                if not self.sign("]"):
                    self.need(",")
        elif v == "(" or v == "<":
            if v == "<" or self.v[self.t.match[self.i] + 1] == "=>":
                self.generics()
                self.parameters()
                self.need("=>")
                self.return_type()
            else:
                self.i += 1
                self.type()
                self.need(")")
        else:
            self.fail("expected a type, not")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take(";") or self.take(","):
                continue
            if self.sign("+") or self.sign("-"):
                self.i += 1
            while self.v[self.i] in ("readonly", "get", "set") and self.k[self.i] == "n" and not (self.k[self.i + 1] == "p" and self.v[self.i + 1] in ("(", ":", "?", "<", ";", ",", "}")):
                self.i += 1
            if self.take("new"):
                pass
            elif not (self.sign("(") or self.sign("<")):
                if self.sign("[") and self.k[self.i + 1] == "n" and self.v[self.i + 2] in (":", "in"):
                    self.i += 3
                    self.type()
                    if self.word("as"):
                        self.i += 1
                        self.type()
                    self.need("]")
                else:
                    self.property_name()
                if self.sign("+") or self.sign("-"):
                    self.i += 1
                self.take("?")
            if self.sign("(") or self.sign("<"):
                self.generics()
                self.parameters()
                self.returns()
            elif self.take(":"):
                self.type()
            if not (self.sign("}") or self.take(";") or self.take(",") or self.t.fresh[self.i]):
                self.fail()


def check_script(text: str, ts: bool) -> None:
    tokens = Tokens()
    start = re.match(r"#![^\n\r]*", text)
    _lex(text, tokens, start.end() if start else 0, ts)
    Script(tokens, ts).program()
