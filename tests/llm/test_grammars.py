import ast
import importlib
import inspect
import random

from codeloom.llm import grammars, lexing

GOOD_JAVA = """package a; import b.*; import static c.D.e;
/** x */ @A(v = {1, 2}, w = "}") public final class B<T extends C & D> extends E<T> implements F, G<H[]> {
  static final int[] T1 = {1, 2,}; private Map<String, List<? super T>> m = new HashMap<>() {{ put("a", null); }};
  enum K { X(1) { int f() { return 1; } }, Y; K(int... a) { } K() { this(0); } }
  record R(int a, String... b) implements F { R { if (a < 0) throw new X(); } }
  sealed interface S permits P, Q { default void z() { } }
  static { x = y; } @interface Ann { int v() default 3; }
  <U> U go(final U u, int[]... k) throws X, Y {
    for (int i = 0, j = 1; i < 3; i++, j--) { label: continue label; } for (var q : list) use(q);
    do { a[i]++; } while (b && !c || d instanceof String s); int v = a < b ? (int) -c : d >>> 2;
    switch (v) { case 1: case 2: x(); break; default: y(); } int w = switch (v) { case 1, 2 -> 3; default -> { yield 4; } };
    try (var in = open(); out) { } catch (A | B e) { throw e; } finally { } if (a) b(); else if (c) d(); else { }
    Runnable r = () -> { }; f(x -> x + 1, String::valueOf, int[]::new, (a, b) -> a); synchronized (this) { assert a : "b"; }
    String t = \"\"\"
      text { " block
      \"\"\"; char c1 = '\\'', c2 = '\\u0041'; int[][] z = new int[3][]; new Outer().new Inner(); return super.f().<String>g(); }
}"""
GOOD_JS = """'use strict'; import {a as b} from 'c'; export default class D extends E { static x = 1; #y; get z() { return this.#y } async *f([a, ...b], {c = 1}) { await a; } }
const {p, q: [r]} = s, t = (a, b) => ({a, b, ['c']: 1, ...d, f() {}}), u = async x => { yield1; }
if (a) b()
else c()
for (const k of m) n(k); for (var i = 0, j; i < 3; i++) {} for (k in o) ;
let re = /[/}]+\\/'/g.test(s) ? `t ${a + `b`} }` : 1 / 2
!function(){var x=[84,"a"].map(function(m){return m+4});a&&b;while(c)d--}();
switch (x) { case 1: y(); break; default: z() } label: for (;;) { break label }
export const v = function g() { return void 0 }; try { } catch { } finally { } new X; x ||= y?.z ?? w ** 2; do a++; while (b)"""


def in_method(body):
    return "class A { void f() { " + body + " } }"


BAD_JAVA = [in_method("b(); else { } if (x) {}"),in_method("catch (E e) {} try {} finally {}"),in_method("try {}"),in_method("case 1: b();"),"class A extends B, C {}","class A { private private int x; }",in_method("5 = x;"),in_method("do b(); x();"),in_method("if (a) b(); c(); else d();"),in_method("switch (x) { b(); }"),in_method("switch (x) { case 1 -> b(); case 2: c(); }"),in_method("try {} b(); finally {}"),in_method("a + b;"),in_method("x = ;"),in_method("int 5x = 3;"),in_method("int x y;"),in_method("for (;;"),in_method("return return;"),"class A { void f() { } void g( { } }", in_method("f(a,);"),in_method("finally {}"),in_method("while (x) else y();")]
GOOD_JAVA_PARTS = [in_method("if (a) if (b) c(); else d(); else e();"),in_method("do if (a) b(); else c(); while (d);"),in_method("do while (a) b(); while (c);"),in_method("try { } catch (A e) { } catch (B e) { } finally { } if (x) try { } finally { } else b();"),in_method("l: for (;;) { } while (x);"),in_method("switch (x) { case 1: case 2: { } default: }"),in_method("switch (x) { }"),in_method("int y = switch (x) { case 1 -> 2; default -> throw new E(); };"),"interface A extends B, C { int[] v() default {1, 2}; }","abstract non-sealed class A implements B { }","public @interface X { }","class A<T extends B<T>> { <U extends C & D<T>> List<@N U> f(@A(\"x\") final T... a) throws E { return null; } }", in_method("a[0] = b.c = d; this.x += 1; (a).b = 2;"),"sealed class A permits B, C { } final class B extends A { }", "class A { int permits = 1, record = 2, sealed = 3; void yield() { } }","enum E { A, B; }","enum E { A { void f() { } }, B }", in_method("Runnable r = () -> { if (x) { y(); } else { z(); } };"),in_method("var x = new int[][] {{1}, {2, 3}}; x = new A() { int y; };"),in_method("for (int i = 0, n = a.length; i < n; ++i) ;"),in_method("f(A[]::new, int[].class, a -> b -> c);"),"record P<T>(int x, T y) implements Q { P { } static int z; }", in_method("synchronized (x) { } assert a; assert a : b;"),in_method("String s = a instanceof B b && b.c() ? \"x\" : 'y' + \"\";"),in_method("return (a) -> { return; };"), in_method("return switch (x) { default: yield 1; };")]
BAD_JS = ["try {}","if(a){} b(); else {}","const x;","5 = x","return 5","a => {} + 1","if (a) { return 5 }","catch (e) {}","x = {a: 1,, b}","let {a};","case 1: x()","do x()","function f() { return 1;","f(a b)","var 5;","a b","for (;;","class A { x y }"]
GOOD_JS_PARTS = ["const a = {async *g() {}};","function F(){ return new.target }","const a = {async *g() {}, get x() { return 1 }, set x(v) {}, async h() {}, *i() {}, async: 1, get: 2, static: 3, if: 4, async, get};","a = b\n(c)","a = () => {}\nb()","x = a => b => c","f(function() { return 1 }, class {})","x = function() {}\ny = 2","x = {\n a: function() {\n return 1\n }\n}\ny()","import a, {b} from 'c'\nimport * as d from 'e'\nimport 'f'\nexport * from 'g'\nexport default function() { return 1 }\nexport const z = 1","async function f() { for await (const x of y) { await z } }","function* g() { const a = yield; yield* b; yield c }","label: for (var a in b) { continue label }","do x++\nwhile (y)\nz()","if (a)\n  b()\nelse\n  c()","try { a() } catch { b() }\nfinally { c() }","var re = /a[/]b/g, d = a / b / c","x = `a${`b${c}`}`","a?.b?.[c]?.(d)","x = y ? {a: 1} : [b]","switch (a) {\ncase 1:\n  b()\n  break\ndefault:\n  c()\n}","class A extends B { static #x = 1; static { y() } async *g() {} get [z]() { return 1 } constructor() { super() } 'a b'() {} }","const {a, b: {c}, ...d} = e","({a, b} = c)","[a, b] = [b, a]","x = async () => { await y }","(async () => { await y })()","!function() { return 1 }()","if (a) return_()","const f = async function() { return 1 }","let a = 1, b\nlet c","x = a in b","while (a) b()","new A","new A().b","throw new E('x')","var a = b ? c => { d() } : e","export { a as default, b }","a = b || {}","module.exports = { a, b, c() { return 1 } }","(function() { 'use strict'; var a = 1; return a })();","a.catch(e => { b(e) }).finally(() => {})","x = a ? b : c ? d : e","function f(a = {}, [b, c] = [], {d} = {}, ...e) { return }","const g = (a, b = 1) => ({ c: a })","if (a) { } else if (b) { } else { }","for (const [k, v] of Object.entries(x)) { y }","for (let i = 0; i < 3; i++) { if (i) continue; break }","x = {...a, b}","`a`.b()","tag`x`"]
BAD_PY = [
    "print 'a'", "a\0b", "if x:\ny", "x = 1\n  y = 2", "def f(a=1, b): pass", "f(a=1, b)", "5 = x", "f() = x", "try:\n  x\ny", "else: x",
    "for x in y: z\nelif a: b", "@a\nx = 1", "x = 8da6", "x = 012", "lambda: (yield", "import a.b as c.d", "from . import", "class A(: pass",
    "if a:\n    b\n  c", "x +", "f(a for a in b, c)", "match x:\n  y", "a b", "{1: 2, 3}", "async x"]
GOOD_PY = [
    "x = 1\n", "", "match x:\n  case [a, *b] if c: pass\n  case {'d': 1}:\n    e\nmatch = 3; case = type = match",
    "try:\n\tx\nexcept (A, B) as e: y\nelse:\n\tz\nfinally: w",
    "@a.b(c)\n@d\nasync def f(a, /, b: int = 1, *, c, **d) -> e:\n  async with g as h, i: await j",
    "x = [a async for a in b if c for d in e], {**f, 'g': h}, {i for i in j}, (yield)", "with (open(a) as b, c): pass",
    "a, *b = c = d\ne: int = 3\nf += yield", "print(f'{a[\"b\"]}' f\"{c}\")", "if (y := x[1:2, ::3, ...]) not in z and a is not b: pass",
    "x = lambda a, *b, c=1: a if b else c", "if a:\n  if b: c\n  elif d:\n    e\n# f\ng", "a = 1 if b else 2 \\\n  + 3",
    "def f():\n  \"\"\"d\n e\n\"\"\"\n\n  return (\n1)\n", "for a, in b: pass\nelse: c",
    "from .a import (b as c, d,)\nfrom ... import e\ndel a[1], b.c", "assert x, y; raise A from b", "\ufeffx = 1"]


def test_grammars():
    v = grammars.valid
    assert v("java", GOOD_JAVA) and v("java", "") and v("java", "/** p */ package a.b;") and v("js", GOOD_JS) and v("js", "")
    bad = ["class A { int f() { return (1; } }", "class A { void f() { int x = 1 } }", "class A { void f() { x = y + ; } }", "class A {", "class A { } }", "x = 1;",
           "class A { String s = \"a; }", "class A { /* }", "<<<<<<< HEAD\nclass A { }", "class A { void f() { g(1)) ; } }", "class A { void f() { else g(); } }", "def f(a):\n  pass", "import a class B { }"]
    assert not [b for b in bad + BAD_JAVA if v("java", b)]
    bad = ["function f( { }", "let x = 1 +;", "f(1)) ;", "a = 'b;", "if (a {", "<html><body>x y</body></html>", "{\"a\": 1, \"b\": 2}", "package a;", "function f() { return 1;", "x = {a: 1,, b}", "/* "]
    assert not [b for b in bad + BAD_JS if v("js", b)]
    assert [b for b in GOOD_JAVA_PARTS if not v("java", b)] == [] and [b for b in GOOD_JS_PARTS if not v("js", b)] == []
    assert v("json", '{"a": [1, null]}') and v("json", " -1.5e3\n") and v("json", "[" * 5000 + "]" * 5000)
    assert not [b for b in ('{"a": 1,}', "", "[NaN]", "[01]", '{"a" 1}', "[1] [2]", "{'a': 1}", '"a\nb"', "(1)", '{"a": 1, 2}') if v("json", b)]
    assert [b for b in GOOD_PY if not v("py", b)] == [] and [b for b in BAD_PY if v("py", b)] == []


def test_python_grammar_agrees_with_the_running_python():
    """The library's own sources, whole and damaged at random."""
    r = random.Random(7)
    for name in ("ast", "tokenize", "dataclasses", "typing", "traceback", "asyncio.tasks", "argparse"):
        lines = inspect.getsource(importlib.import_module(name)).split("\n")
        for k in range(-1, 30):
            damaged = lines[:]
            at = r.randrange(len(lines))
            if k >= 0:
                damaged[at] = [damaged[at][:r.randrange(len(damaged[at]) + 1)], " " + damaged[at], damaged[at].replace(")", "", 1), "=======", damaged[at].replace(" ", "", 1)][k % 5]
            source = "\n".join(damaged)
            try:
                ast.parse(source)
                right = True
            except SyntaxError:
                right = False
            assert grammars.valid("py", source) == right, (name, at, damaged[at])


TEXTS = {
    "java": "class A {\n /* a\n } */ String s = \"{\";\n void f() {\n  g(\n1);\n }\n String t = \"\"\"\n { \" /*\n \"\"\";\n}\n",
    "js": "var a = `x\n { ${b}\n`; /* '\n \" */ f({\n a: 1 }\n)\nif (c)\n  d()\n",
    "py": "def f(\n  a):\n  '''x\n  ( \"\n  '''\n  return {\n1: \"\"\"y\n'''\"\"\"}\n", "json": "{\"a\":\n [1,\n 2]}"}


def test_chunks_join_in_any_order():
    """Whatever the chunks, the joined map is the whole text's; maps may be joined in any grouping."""
    start = lexing.Summary(lexing.CODE, "", "", "")
    for language, text in TEXTS.items():
        rows = text.split("\n")
        whole = lexing.state_map(language, text, True)[lexing.CODE]
        assert whole[:3] == (lexing.CODE, "", "") and grammars.PARSES[language](whole.stream)
        for size in (1, 2, 3, 5):
            maps = [lexing.state_map(language, "\n".join(rows[i:i + size]), i == 0) for i in range(0, len(rows), size)]
            left = start
            for m in maps:
                left = lexing.joined(left, m)
            pairs = [maps[0]] + [{k: lexing.joined(s, b) for k, s in a.items()} for a, b in zip(maps[1::2], maps[2::2])] + ([maps[-1]] if len(maps) % 2 == 0 else [])
            grouped = start
            for m in pairs:
                grouped = lexing.joined(grouped, m)
            assert left == grouped and left[:3] == whole[:3], (language, size)
            assert grammars.PARSES[language](left.stream), (language, size)
