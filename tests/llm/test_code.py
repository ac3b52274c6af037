"""Operators on source code: documentation, validity, authorship."""

import datetime as dt
import random

import pytest

from lodegraph.llm import docs, handwritten, lexstates, parsing
from lodegraph.llm.grammar import problem

ENT = "id string, repository_id string, entity_type string, name string, qualified_name string, file_path string, start_line int, signature string, docstring string, content string, updated_at timestamp, language string, kind string, line long, created_at timestamp"
T = dt.datetime(2024, 1, 1)


def row(id, kind, path, content, name=None, start=None, doc=None, repo="r", at=T, signature=None, qualified=None, made=None):
    return (id, repo, kind, name, qualified or name, path, start, signature, doc, content, at, None, "clash", 1, made)


# validity

VALID = {
    "javascript": [
        "", "#!/usr/bin/env node\nimport a, { b as c, default as d } from 'x';\nexport * as z from 'y';\nexport { q as default };",
        "const { a, b: [c = 1, ...d], ...e } = f(...g), h = async (x, { y }) => { await x; };\nfor (const [k, v] of Object.entries(o)) { if (k) continue; else break }\n",
        "class A extends (b, C) { static #p = 1; get x() { return this.#p } static { init() } async *gen() { yield* z; } [k + 1] = 2; 'str'() {} }",
        "let r = /[/\\]]+/g.test(s) ? a / b / c : `t ${`n ${x}`} ${ {a: 1}.a }`\nlet x = a\n++b\nlabel: for (;;) { break label }",
        "switch (x) { case 1: default: y() }\ntry { a() } catch { b() } finally { c() }\ndo x++; while (x < 5) y = z ?? w?.[1]?.(2) ** 3",
        "export default async function () { for await (const x of y) z(); }\nvar o = { get, set: 1, get a() { return 1 }, async *b() {}, [c]: d, ...e, if: 1 }", "new.target; new (foo())(1).bar; a = b ? (c, d) : e => f; if (a) /x/.test(b)", "throw new Error('x' + y);\nimport('a').then(({ default: d }) => d);\nconst big = 1_000n, hex = 0xFF, f = .5e-3;",
        "export default {\"a\":[1,2],\"b\":null}", "!function(e,t){function a(b,c){return b.d(1)?c:b}var z=k=>{for(let g=0;g<9;g++)k.x(g)}}();",
    ],
    "typescript": [
        "import type { A } from './a';\nexport type B<T extends object = {}> = { readonly [K in keyof T]?: T[K] } & (A | null)[];\ninterface C<T> extends D<T>, E { (x: number): string; new (y?: T): C<T>; m?(): void; [k: string]: any }",
        "abstract class F<T> implements G, H { private readonly x: Map<string, Array<number>> = new Map<string, Array<number>>(); constructor(public a: string, protected b?: number) { super() } abstract m(): void; static n<U>(u: U): u is U { return true } declare z: number; q!: string }",
        "enum K { A = 1, B = 'x', C }\ndeclare module 'm' { export function f(x: number): void; }\nnamespace N.M { export const x = 1 }\nfunction over(a: string): void;\nfunction over(a: any) {}",
        "const g = <T,>(x: T): x is T => true, h = (a as unknown as B)!.c<D>(e), i = a < b && c > d, j = f<A>`x`, k = x satisfies Y;\nlet t: [a: string, b?: number, ...c: boolean[]] = z, fn: (x: number) => void, cond: A extends infer B ? B : never;",
        "function assertIt(x: unknown): asserts x is string {}\n@dec({ a: 1 }) class L { @p() q: string = 'a'; get r(): number { return 1 } }\nlet m = async <T>(x: T) => x; for (const a of b as C[]) d(a); let s: string[] = q.filter((w) => w !== 'a');",
    ],
    "java": [
        "", "package a.b;\nimport static x.Y.*;\nimport z.W;\n@Ann(a = 1, b = {\"x\", \"y\"}) public final class A<T extends B & C<?>> extends D<T> implements E, F { static { init(); } { x = 1; } private final int[][] a = {{1, 2}, {3}}, b[] = null; A(int x, final String... y) throws G { this(x); } abstract <U> U m(List<? super U> l); }",
        "class A { void m() { for (int i = 0, j = 1; i < 3; i++, j--) { if (x) continue; else break; } for (String s : list) { } int y = (int) z + (String) w.length(); Runnable r = () -> { }; f(a -> a + 1, (b, c) -> b, A::new, int[]::new, List<String>::size); label: while (true) { break label; } do { } while (x); } }",
        "enum E { A(1) { void x() {} }, B; private int z; E(int... y) {} }\nrecord R(int a, @N String b) { R { check(a); } }\n@interface I { int value() default 1; }\nsealed interface S permits T, U {}",
        "class A { int m(Object o) { var s = switch (o) { case Integer i when i > 1 -> 1; case String t -> { yield 2; } case R(int a, var b) -> 3; default -> throw new X(); }; try (var r = open(); q) { } catch (IOException | RuntimeException e) { } finally { } return o instanceof String t && t.isEmpty() ? 1L : 0x1Fp3 > 2 ? 'c' : \"\"\"\n text\n \"\"\".length(); } }",
        "class A { int x = a < b ? c >> 2 : d >>> 3; boolean y = i < MAX && j > MIN; Map<String, List<Integer>> z = new HashMap<>(); static final int[] T = {\n 0xff, 1_000,\n}; long q = 1885L; synchronized void f() { synchronized (this) { assert x > 1 : \"m\"; } x >>= 1; a[0].b().c++; new Foo() { void g() {} }.h(); } }",
    ],
    "go": [
        "package a", "package a\nimport (\n\t\"fmt\"\n\tx \"y\"\n)\nvar (\n\ta, b int = 1, 2\n\tc = map[string][]int{\"x\": {1, 2}, \"y\": nil}\n)\nconst (\n\tA = iota\n\tB\n)\ntype T struct {\n\t*E\n\tx, y int `json:\"x\"`\n\tpkg.F\n}\n",
        "package a\nfunc (s *T[K]) m(a, b int, c ...string) (x int, err error) {\n\tif v, ok := s.f[a]; ok && v > 0 {\n\t\treturn 1, nil\n\t} else if x := f(); x {\n\t} else {\n\t}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor _, v := range c {\n\t\tgo func() { ch <- v }()\n\t}\n\tfor range 3 {\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tswitch y := z.(type) {\n\tcase int, []string:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase <-ch:\n\tcase v := <-ch:\n\tcase ch <- 1:\n\t}\n\tdefer s.mu.Unlock()\n\ta, b = b, a\n\tx &^= 3\n\treturn\n}\n",
        "package a\nfunc Map[T, U any](xs []T, f func(T) U) []U { var out []U; out = append(out, xs...); _ = xs[1:2:3]; _ = struct{ a int }{1}; p := &T{a: 1}; if (T{} == *p) { }; return out }\ntype N interface {\n\t~int | ~string\n\tM(int) error\n}\ntype F func(int, string) (bool, error)\ntype C <-chan int\n",
    ],
    "python": ["", "\n", "x = 1\n", "match x:\n    case [1, *y] if y: pass\n", "# only a comment"],
}
INVALID = {
    "javascript": ["let x = ;", "function (a) {}", "foo(a, b;", "if (x { }", "a b", "const { a b } = c", "class A { x y }", "'open", "`open ${x", "/* open", "<<<<<<< ours\nx", "x = 1fb6d5f", "let s: string = 1", "# title", "{ \"a\": 1, \"b\": 2 }", "a;b;c d", "<!doctype html>", "def f():\n  return 1", "package main", "return }", "try { }", "x => { ", "1 = 2"],
    "typescript": ["interface { }", "let x: = 1", "type A = ", "enum { A }", "class A { m(: string) {} }", "function f(a: string b: number) {}", "=======", "const a: number[ = 1"],
    "java": ["class", "class A {", "class A { int x }", "class A { void m() { x = ; } }", "class A { void m() { f(a; } }", "x = 1;", "class A { String s = \"open; }", "import a.b", "class A { void m() { int 1x; } }", "class A { void m() { a b c; } }", "class A { void m() { x + y; } }", "{\"a\": 1}", "class A { void m() { if x { } } }", "class A { >>>>>>> 2e70b57\n }", "class A { void m( { } }"],
    "go": ["", "func f() {}", "package a\nx := 1", "package a\nfunc f() { if x { }", "package a\nfunc f() { a b }", "package a\nfunc f() { f(a }", "package a\nfunc f()\n{\n}", "package a\nfunc f() {\n\tif x\n\t{\n\t}\n}", "package a\nvar s = \"open", "package a\nimport \"b\"\nvar x = 1\nimport \"c\"", "package a\nfunc f() { for i := 0; i < 3 { } }", "package a\nfunc f() { x = [1, 2] }", "package a\nfunc f() { else { } }"],
    "python": ["def f(:\n", "x = (1,\n", "  x = 1\n y", "if x:\n", "print 'a'", "x = 'open", "\x00"],
}


@pytest.mark.parametrize("language", list(VALID))
def test_grammars(language):
    for text in VALID[language]:
        assert problem(text, language) is None, text
        assert problem("﻿" + text, language) is None
    for text in INVALID[language]:
        assert problem(text, language) is not None, text


@pytest.mark.parametrize("language", ["java", "go"])
def test_states_compose_in_any_grouping(language):
    rnd = random.Random(1)
    parts = ["x = \"a(\";\n", "// } \n", "/* { \n", " */ }\n", "f(a,\n", ")\n", "{\n", "}\n", '"""\n' if language == "java" else "`\n", "'('\n", "[1]\n", '"open\n']
    for _ in range(300):
        lines = [rnd.choice(parts) for _ in range(rnd.randint(1, 14))]
        whole = lexstates.chunk_map("".join(lines), language)
        maps = [lexstates.chunk_map(x, language) for x in lines]
        left = maps[0]
        for m in maps[1:]:
            left = lexstates.compose(left, m)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = lexstates.compose(m, right)
        for got in (left, right):
            assert {k: v if isinstance(v, tuple) else "bad" for k, v in got.items()} == {k: v if isinstance(v, tuple) else "bad" for k, v in whole.items()}


def test_unparsable_files(spark):
    good = "package a\n" + "".join(f"func f{i}(x int) int {{\n\treturn g(x, {i})\n}}\n" for i in range(900))
    rows = [
        row("1", "FILE", "a.py", "def f(:\n"), row("2", "file ", "b.py", ""), row("3", "FILE", "c.go", ""), row("4", "FILE", "d.go", good), row("5", "FILE", "e.go", good[:-4]), row("6", "FILE", "f.txt", "((("),
        row("7", "FILE", "g.js", None), row("8", "FILE", None, "((("), row("9", "CLASS", "h.py", "((("), row("1 ", "FILE", "a.py", "def f(:\n"), row("10", "FILE", "i.JS", "let = = 1"), row("11", "FILE", "j.java", "class A { }", at=None), row("12", "FILE", "k.py", "(((", repo=None),
    ]
    df = spark.createDataFrame(rows, ENT)
    for size in (16 << 10, 500):
        got = sorted((r.repository_id or "", r.file_path) for r in parsing.unparsable(df, size).collect())
        assert got == [("", "k.py"), ("r", "a.py"), ("r", "c.go"), ("r", "e.go"), ("r", "i.JS")]
    rates = {(r.repository_id, r.language): (r.files, r.invalid) for r in parsing.parse_rates(parsing.check_files(df)).collect()}
    assert rates[("r", "go")] == (3, 2) and rates[("r", "python")] == (2, 1)
    assert parsing.unparsable(df.where("false")).count() == 0


def test_maps_of_many_ranges(spark):
    """Texts of thousands of chunks: the maps are composed over several levels, wherever they lie."""
    body = "".join(f'func f{i}() {{ g("{{", `[\n`, {i})\n}}\n' for i in range(3000))
    texts = {"good": "package p\n" + body, "open": "package p\n" + body + "func h() {\n", "kind": "package p\nfunc h() { x[(1]) }\n" + body, "late": "package p\n" + body + 'import "x"\n'}
    df = spark.createDataFrame([row(k, "FILE", f"{k}.go", t) for k, t in texts.items()], ENT).repartition(4)
    got = {r.entity_id: (r.problem is None, r.stage) for r in parsing.check_files(df, 10).collect()}
    assert got == {"good": (True, "statements"), "open": (False, "maps"), "kind": (False, "maps"), "late": (False, "statements")}
    stages = {(r.stage, r.files, r.invalid) for r in parsing.parse_stages(parsing.check_files(df, 10)).collect()}
    assert stages == {("maps", 2, 2), ("statements", 2, 1)}


def test_statements():
    for language, texts in (("go", ["package p\nimport (\n\t\"a\"\n)\nimport \"b\"\nvar x = 1 +\nfunc() int { return 1 }()\n", "package p\n/*\nfunc\n*/\nvar s = `\nvar`\ntype T struct {\n\tvar_ int\n}\n", "package p"]), ("java", ["package a;\nimport b.C;\n@X({1})\nclass A { void f() { } }\n/* { */ interface B { }\n;", "", "class A { }"])):
        for text in texts:
            assert parsing.by_statements(text, language) is None, text
    assert parsing.by_statements("class A { }\nimport b.C;\nclass D { }", "java") and parsing.by_statements("package p\nfunc f() { }\nfunc { }\n", "go")


# documentation

SAYS = "Keeps every lease in order until the broker drops its oldest token."


def test_descriptions():
    for text in ("TODO: write this down later", "/** {@inheritDoc} */", "@param x the first number of all\n@return the second number of all", "Args:\n    x: the first number of them all.\n\nReturns:\n    all of the numbers in there", "Parameters\n----------\nalpha : int\nbeta_gamma : str", "// eslint-disable-next-line complexity and all that follows", "SPDX-License-Identifier: Some-Long-Name-Of-It", "/** value = compute(first, second, third, fourth, fifth); */", "# ~~~~~~~", ":param a: the long one of them\n:returns: another long one here", None, "", "   \n"):
        assert docs.telling_words(text, "f") < 5, text
    for text in (SAYS, f"/**\n * {SAYS}\n * @param x y\n */", f"// {SAYS}", f'"""{SAYS}\n\nArgs:\n    x: y\n"""', "Set limit to 5 when the payload is acyclic;\notherwise it may ingest a lease.", "トークンを数えて、木の深さを記録する。"):
        assert docs.telling_words(text, "f") >= 5, text
    assert docs.telling_words("Load the user record from disk", "load_user_record_from_disk") < 5


def test_documented_functions(spark):
    py = f'# {SAYS}\ndef above(x):\n    return x\n\n# {SAYS}\n\ndef gap(x):\n    return x\n\ndef inner(x, y=")"):\n    """{SAYS}"""\n    return x\n\ndef bare(x):\n    # needs the lazy token of the other broker here\n    return x\n'
    lines = py.split("\n")
    cut = lambda a, b: "\n".join(lines[a - 1 : b])
    decl = "interface A { void put(int key, String value); }"
    rows = [
        row("f", "FILE", "m.py", py), row("above", "FUNCTION", "m.py", cut(2, 3), "above", 2), row("gap", "Function", "m.py", cut(7, 8), "gap", 7), row("inner", "METHOD", "m.py", cut(10, 12), "inner", 10), row("bare", "FUNCTION", "m.py", cut(14, 16), "bare", 14),
        row("col", "FUNCTION", "x.py", "def col(): pass", "col", 1, SAYS), row("lead", "METHOD", "x.js", f"  /** {SAYS} */\n  lead() {{ }}", "lead", 3), row("todo", "METHOD", "x.js", "lead() { }", "todo", 3, "TODO"), row("nul", "METHOD", None, None, None, None), row(None, "FUNCTION", "m.py", "def z(): pass", "z", 2, SAYS), row("cls", "CLASS", "m.py", "x", "c", 2, SAYS),
        row("COL ", "FUNCTION", "x.py", "def col(): pass", "col", 1, SAYS),
        row("d", "METHOD", "A.java", "void put(int key, String value);", "put", 1, SAYS, signature="void put(int key, String value)", qualified="A.put"), row("i", "METHOD", "B.java", "public void put(int k, String v) { x(); }", "put", 5, signature="public void put(int k, String v)", qualified="A.put"), row("o", "METHOD", "B.java", "public void put(long k) { x(); }", "put", 9, signature="public void put(long k)", qualified="A.put"),
    ]
    df = spark.createDataFrame(rows, ENT)
    got = {r.entity_id: r.source for r in docs.documented_functions(df).collect()}
    assert got == {"above": "above", "inner": "content", "col": "docstring", "lead": "content", "d": "docstring", "i": "declaration"}
    assert docs.documented_functions(df.where("false"), texts=False).count() == 0
    assert decl


def test_signatures():
    for ext, signature, shape in (
        ("go", "func (s *Store[K, V]) Put(ctx context.Context, a, b int, opts ...func(x int) error) (int, error)", "(context.Context,int,int,...func(xint)error)"), ("go", "func f(int, string)", "(int,string)"), ("go", "func f()", "()"),
        ("java", "public <T> void put(final Map<String, List<T>> m, @Nullable int[] a, String... rest)", "(Map<String,List<T>>,int[],String...)"), ("java", "int f(int a[])", "(int[])"),
        ("py", "def f(self, a, b: dict[str, int] = {}, *args, c=(1, 2), **kw: int) -> int", "(_,dict[str,int],*,_,**int)"), ("ts", "put(this: X, a?: number, f: (x: string) => void = g, ...r: T[])", "(number,(x:string)=>void,...T[])"), ("js", "f(a, b = {x: 1})", "(_,_)"), ("py", None, ""), (None, "x", ""),
    ):
        assert docs.normal_signature(signature, ext) == shape, signature


# authorship


def kind(path, text):
    return (handwritten.judge(path, text) or [None])[0]


def test_judgements():
    code = "import a\n\n" + "".join(f"def f{chr(97 + i)}(x):\n    value = table.lookup(x, 'name {i}')\n    if value is None:\n        raise KeyError(x)\n    return value.{chr(97 + i)}\n\n" for i in range(12))
    assert kind("src/a.py", code) is None
    for notice in ("Code generated by protoc-gen-x. DO NOT EDIT.", "This module was compiled from grammar.peg with pegen;\n# changes to it will be overwritten.", "Diese Datei wurde generiert durch cmake. Bitte nicht ändern!", "Fichier produit par bison ; ne jamais modifier.", "Archivo creado con swig, no modificar", "Файл сгенерирован с помощью bison, не редактировать", "このファイルは自動生成されました。編集しないでください", "由 protoc 生成，请勿修改"):
        assert handwritten.judge("src/a.py", f"# {notice}\n{code}") == ("generated", "notice"), notice
        assert kind("src/a.py", f"{code}\n# {notice}\n") == "generated", notice
        assert kind("src/a.py", code.replace("    return value.c", f"    # {notice}\n    return value.c")) is None
    for remark in ("Please do not edit the order of entries; tests depend on it.", "Compares generated parsers with the ones we maintain.", "Created by Jo in March; ask before you change it.", "Produces the report that is generated from the ledger each night.", "Nicht bearbeiten, solange der Umbau läuft.", "Ne pas modifier sans revue."):
        assert kind("src/a.py", f"# {remark}\n{code}") is None, remark
    assert kind("src/codegen/a.py", code) is None and handwritten.judge("lib/gen/a.py", code) == ("generated", "path") and kind("src/a_pb2.py", code) == "generated"
    assert kind("src/vendor/x-1.2/a.py", code) == "vendored" and kind("src/vendor_portal/a.py", code) is None
    assert kind("src/x.py", "# fastgraph 0.4.1, copyright (c) 2019 the fastgraph authors, MIT license\n" + code) == "vendored"
    assert kind("d/a.js", "(()=>{var e={};" + "".join(f"function a{i}(b,c){{return b.x({i})?c:b}}" for i in range(60)) + "})();") == "minified"
    assert kind("d/a.js", "// " + "word " * 400 + "\n" + "function load(key) {\n  return table.get(key);\n}\n" * 5) is None
    assert kind("d/a.py", "T = [\n" + "    1, 2, 3, 4,\n" * 60 + "]\n") == "data" and kind("d/a.js", 'export default {"a":[1,2],' + ",".join(f'"k{i}":[{i},2]' for i in range(60)) + "}") == "data"
    assert kind("d/a.py", "".join(f"a{i};{i};Some words\n" for i in range(20))) == "data"
    assert kind("d/a.go", "package a\n\n" + "".join(f"func Get{i:04}(r []int) int {{\n\treturn r[{i}]\n}}\n\n" for i in range(40))) == "generated"


def test_copies(spark):
    line = lambda s, i: f"    {s}_{chr(97 + i % 26)}{chr(97 + i % 7)} = lookup.value_{chr(99 + i % 23)}_of_{s}(limit_{chr(97 + i % 5)}, 10)"
    lib, mine, first = ([line(s, i) for i in range(30)] for s in ("lib", "mine", "first"))
    edited = [x.replace("10", "20").replace("    ", "\t") for x in first[:24]] + mine[:3]  # other numbers and indentation
    later = dt.datetime(2025, 1, 1)
    everywhere = [line("licence", i) for i in range(30)]
    rows = [
        row("v", "FILE", "vendor/lib-1.0/a.py", "\n".join(lib), repo="r1"), row("copy", "FILE", "src/util.py", "\n".join(lib[:25] + mine[:3]), repo="r2"), row("own", "FILE", "src/own.py", "\n".join(mine), repo="r3"),
        row("some", "FILE", "src/some.py", "\n".join(lib[:4] + mine[5:]), repo="r3"), row("same", "FILE", "src/same.py", "\n".join(lib), repo="r1"), row("void", "FILE", "vendor/x.py", " \n", repo="r1"), row("null", "FILE", "vendor/y.py", None, repo="r1"), row("path", "FILE", None, "\n".join(mine), repo=None), row(None, "FILE", "vendor/z.py", "x", repo="r1"),
        row("first", "FILE", "src/first.py", "\n".join(first), repo="r4", made=T), row("taken", "FILE", "src/taken.py", "\n".join(edited), repo="r5", made=later), row("taken", "FILE", "src/taken.py", "\n".join(edited), repo="r5", made=later), row("again", "FILE", "src/again.py", "\n".join(first), repo="r4", made=later), row("undated", "FILE", "src/u.py", "\n".join(first), repo="r6"),
        *[row(f"e{i}", "FILE", "LICENCE.py", "\n".join(everywhere), repo=f"s{i}", made=T + dt.timedelta(i)) for i in range(9)],
    ]
    df = spark.createDataFrame(rows, ENT)
    got = {r.entity_id: (r.kind, r.way, r.contained) for r in handwritten.not_handwritten(df).collect()}
    # the lines of e0 to e8 stand in 9 of 15 repositories: they are not rare
    assert got == {"v": ("vendored", "path", None), "copy": ("vendored", "containment", got["copy"][2]), "taken": ("vendored", "containment", got["taken"][2])}
    assert got["copy"][2] > 0.8 and got["taken"][2] > 0.8
    assert handwritten.not_handwritten(df.where("false")).count() == 0
