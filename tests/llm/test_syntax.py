"""Grammars accept whole valid files and report the first error line of broken ones."""

import ast
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodeplane.llm import syntax as X

VALID = {
    "python": [
        "#!/usr/bin/env python3\nimport a.b as c, d\nfrom . import (x, y as z,)\n\nclass A(B, metaclass=M):\n    x: int = 3\n    @property\n    async def f(self, a, /, b=1, *args, c: str = '', **kw) -> 'T':\n        async with a as b, c:\n            return [i async for i in x if i]\n",
        "match x:\n    case [1, *rest] | {'a': b, **r} if y:\n        pass\n    case P(a=1) as q: print(f'{q!r}')\n    case _:\n        raise E from None\ntype = 3\nmatch = type\n",
        "x = (yield)\na[1:2, ::3] = b = lambda *a, k=2: (k if a else not k)\nd = {**a, 'b': 1}\nif (n := 3) > 2: pass\nelse:\n\tprint('''x\n''' \"y\", end='')\nt = a if b else\\\n c\n",
        "﻿x = 1_000 + 0xFF - 1e-3j\n\ndef f[T](x: T): ...\n",
    ],
    "javascript": [
        "'use strict'\nimport a, {b as c} from 'x'\nexport default async function* f({a = 1, ...r}, [b,,c] = []) { for await (const x of y) { yield* x } }\n",
        "const f = async (a, {b}) => ({...a, [b]: 1, get x() { return 1 }, async *g() {}})\nlet r = a / b / /[/]x(/g.test(s) ? `t${a ? `n${b}` : ''}` : c?.[0]?.(1) ?? d\n",
        "class A extends B { static #x = 1; static { init() }\n  y\n  'z' = 2\n  constructor() { super(); if (a) b; else c }\n}\nlabel: for (;;) { break label }\ndo x++; while (x < 5)\nvar of = 1, async = 2, let1 = async\n",
        "switch (a) { case 1: b; default: { c } }\ntry { a() } catch { b() } finally { c() }\n!function(h){for(var i=0;i<h.length;i++)h[i]&&(h[i]=3)}(window.x||[]);if(a)b;else c\n",
    ],
    "typescript": [
        "import type { A } from './a'\nexport abstract class C<T extends A = any> implements D<T>, E {\n  private readonly x?: Map<string, Array<number>>;\n  constructor(private a: string, public b = 1) { super() }\n  abstract f(): void\n  get y(): number { return this.x!.size as number }\n}\n",
        "type X<T> = T extends (infer U)[] ? { readonly [K in keyof U]?: U[K] } : `a${string}` | null\ninterface I extends J<K> { (a: number): string; new (b?: X): I; [k: string]: unknown, m<T>(x: T): x is string }\ndeclare module 'm' { export function f(a: number): void }\nenum E { A = 1, B }\n",
        "const g = <T,>(x: T, ...r: T[]): Promise<Map<string, T>> => f<T>(x) satisfies Y\nfunction h(a: string): void\nfunction h(a: any) { return a < 1 && b > (c >> 2) }\nlet v = y as unknown as Record<string, () => void>\n",
    ],
    "go": [
        'package a\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\ntype T[P any] struct {\n\tA, B int `json:"a"`\n\t*E\n}\n\nfunc (t *T[P]) F(a, b int, c ...string) (r []map[string]int, err error) {\n\tif v, ok := m[k]; ok && v > 1 {\n\t\treturn\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- <-d }()\n\t}\n\tswitch y := x.(type) {\n\tcase int, *T[int]:\n\tdefault:\n\t\tdefer f()\n\t}\n\treturn []int{1, 2}, nil\n}\n\nvar z = map[string][]int{\n\t"a": {1},\n}\n',
        "package a\nconst (\n\tA = iota\n\tB\n)\ntype I interface {\n\t~int | string\n\tM(x int) error\n}\nfunc f() { select { case x := <-c: _ = x; default: } ; L: for { break L } }\nvar r = 'x'\nvar s = `raw\n{ (`\n",
    ],
    "java": [
        'package a.b;\n\nimport static java.util.*;\n\n@A(x = {1, 2}, y = @B)\npublic final class C<T extends D & E<?>> extends F implements G, H<T[]> {\n    static { init(); }\n    private int[] a = {1, 2}, b[];\n    public <U> C(final List<? super U> x, int... y) throws Z { this(x); }\n    Map<String, List<int[]>> m() { return x -> { for (var e : y) { e++; } }; }\n    enum K { A(1) { void f() {} }, B; int z; }\n    record R(int a, String... b) {}\n    @interface N { int v() default 1; }\n}\n',
        'class A { void f() { int x = (int) y + (a < b ? c >>> 2 : d); switch (x) { case 1, 2 -> { } default -> throw new E(); } try (var r = g()) { } catch (X | Y e) { } finally { }\n String s = """\n  a "b" \\n\n """; Function<A, B> h = A::new; if (o instanceof P(int q, var w) && q > 1) return; label: do { continue label; } while (true); List<String>[] l = new List[3]; synchronized (this) { } char c = \'\\u0041\'; } }\n',
    ],
    "json": ['{"a": [1, -2.5e3, null, true], "b": {"c": "\\u00e9\\n"}}\n', "[]", '"x"', " 1 "],
}
BROKEN = {
    "python": [("def f(:\n  pass\n", 1), ("x = 1\n  y = 2\n", 2), ("if a:\nb\n", 2), ("print 'x'\n", 1), ("a = (1\n", 1), ("x = 'a\n", 1), ("<<<<<<< HEAD\n", 1), ("x = 012\n", 1), ("if a:\n        b\n    c\n", 3)],
    "javascript": [("function f( { }\n", 1), ("let a = [1, 2;\n", 1), ('{"name": "x"}\n', 1), ("x = 1\n=======\n", 2), ("var s = 'a\n", 1), ("const t = `a${b`;\n", 1), ("class A { f( }\n", 1), ("if (a) { b\n", 1)],
    "typescript": [("interface A { x: }\n", 1), ("const a: = 1;\n", 1), ("let x: Array<number = 1;\nlet y = 2\n", 1), ("import json\nimport logging\n", 2)],
    "go": [("package a\nfunc f( {\n}\n", 2), ("import \"x\"\n", 1), ("package a\nvar x = []int{1\n}\n", 2), ("package a\nfunc f() {\n", 2), ("package a\nx := 1\n", 2)],
    "java": [("class A { int f( { } }\n", 1), ("class A { void f() { int x = 1 } }\n", 1), ("class A {\n", 1), ("﻿class A { }\n", 1), ("def f(): pass\n", 1)],
    "json": [("{'a': 1}", 1), ("[1,]", 1), ("[1 2]", 1), ("", 1), ("﻿{}", 1), ("[01]", 1), ('{"a": "b\n"}', 1), ("[NaN]", 1), ("{}{}", 1)],
}

VALID["javascript"] += ["if (x) /re/.test(y);\nwhile (a) /b/.exec(c)\nfor (const x of y) /a/.test(x)\nz = (a) / 2 / b\n", "if (a &&\n    b) /re[/]/.test(c)\n", "for await (const x of y) /'/.test(x)\n", "[a, b] = [b, a];\n({a, b: c.d} = e);\nf().x = g()[1] += 2\nfor (x.y of z) ;\nlet {q} = r, s\n"]
VALID["typescript"] += ["function f(this: Foo, a: number) { return this.x! as any }\nx!.y = 1\n(x as any).y = 2\ndeclare const z: string\n", "if (x) /re/.test(y)\n"]
VALID["python"] += ['f"{a!r:>{w}} {b=} {c:%Y-%m} {{}} {x["k"]} {f\'{1}\'}" + rf"\\d{n}" f\'\'\'{\n  y\n}\'\'\' fr"{x:{y}}"\n', "def f(a, b=1, /, c=2, *, d, e=3, **k): pass\nf(a, *b, c=1, *d, **e, f=2)\nf(x for x in y)\nlambda a, *, b=1: 0\n", "(a, [b, *c]), d.e, f[0] = x = y\na: int = 1\n(a.b): int\nx.y += 1\ndel a, (b.c, d[0])\nfor a, (b, *c) in d: pass\n(await x).y = 1\n"]
VALID["java"] += ["class A { int y; void f() { x = 1; a.b[0] += 2; i++; --j; g(); a.b().c(); new B(); this.x = y = 2; super.f(); A.<T>g(); (x) = 3; Runnable r = () -> x(); int z = a < b ? c : d; } A() { this(1); } }\n"]
for _lang, _texts in {
    "python": ["1 = x\n", "f() = 3\n", 'f"{a b}"\n', "def f(a, a=1, b): pass\n", "f(a=1, b)\n", "f(**a, *b)\n", "f(x for x in y, z)\n", "del f()\n", "for f() in y: pass\n", 'f"{"\n', 'f"}"\n', 'f"{a!x}"\n', "x + 1 = 2\n", "lambda a=1, b: 0\n", "def f(*): pass\n", "a, b += 1\n", "a, b: int\n"],
    "javascript": ["1 = x;\n", "const x;\n", "let let = 1;\n", "f() = 1;\n", "let {a};\n", "a + b = c;\n"],
    "java": ["class A { void f() { x + 1; } }\n", "class A { void f() { 1 = 2; } }\n", "class A { void f() { x; } }\n", "class A { void f() { f() = 2; } }\n"],
}.items():
    BROKEN[_lang] += [(t, 1) for t in _texts]


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(lang, text):
    assert X.error_line(lang, text) == 0
    assert X.error_line(lang, text.replace("\n", "\r\n")) == 0


@pytest.mark.parametrize("lang,text,line", [(k, t, n) for k, v in BROKEN.items() for t, n in v])
def test_broken(lang, text, line):
    got = X.error_line(lang, text)
    assert got > 0
    if text.count("\n") > 1:
        assert got in (line, line + 1)


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in VALID.items() if k != "json" for t in v])
def test_truncation_at_an_open_bracket_is_found(lang, text):
    """Cut where most brackets are open; comments, strings and templates of the samples hold none that mislead."""
    cuts = [i for i, c in enumerate(text) if c in "({["]
    assert any(X.error_line(lang, text[: i + 1]) for i in cuts) or not cuts


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(VALID["python"]), st.integers(0, 400), st.sampled_from(["", ":", "(", "]", "\n", " ", "=", "x"]))
def test_python_agrees_with_the_interpreter(text, at, piece):
    text = text.lstrip("﻿")
    at %= len(text)
    mutated = text[:at] + piece + text[at + 1 :]
    try:
        ast.parse(mutated)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    if valid:
        assert X.error_line("python", mutated) == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='{}[]",:0123456789.eE+-truefalsn \n\\u', max_size=30))
def test_json_agrees_with_the_library(text):
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        valid = True
    except (ValueError, ZeroDivisionError):
        valid = False
    assert (X.lexer("json").error_line(text) == 0) == valid


def test_table(spark):
    rows = [(1, "a.py", "x = (", "r"), (1, "a.py", "x = (", "r"), (2, "a.PY", "x = 1", "r"), (3, "b.json", None, "r"), (4, "b.json", "  \n", "r"), (5, "c.txt", "((", "r"), (6, None, "((", "r"), (7, "d.mjs", "let x = {", None), (8, "e.java", "class A {}" + " " * 300_000, "r")]
    df = spark.createDataFrame(rows, "file_id bigint, path string, content string, repo_id string").selectExpr("*", "1 as language", "2 as error_line")
    assert {r.file_id for r in X.invalid_files(df).collect()} == {1, 7}
    rates = {(r.repo_id, r.language): (r.files, r.invalid) for r in X.error_rates(df).collect()}
    assert rates == {("r", "python"): (2, 1), (None, "javascript"): (1, 1), ("r", "java"): (1, 0)}
    assert X.invalid_files(df.limit(0)).collect() == []


def test_memory_of_one_text_is_bounded():
    from lodeplane.llm import automaton

    g = X.lexer("json").g
    text = "[" * 2_000 + "1" + "]" * 2_000
    limit, automaton.LIMIT = automaton.LIMIT, 500
    try:
        many = "[" + ",\n".join(f'{"[" * (i % 50)}{i}{"]" * (i % 50)}' for i in range(3_000)) + "]"
        assert X.error_line("json", many) == 0 and X.error_line("json", many[:-1]) > 0
        assert len(g._nodes) + len(g._sets) + g._known_lines < 2_000
    finally:
        automaton.LIMIT = limit
    assert X.error_line("json", text) == 0
