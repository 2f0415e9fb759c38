import ast
import random

import pytest

from lodestone.llm import files, peg, provenance, syntax
from lodestone.llm.grammars import EXTENSIONS, language
from tests.conftest import rows

GOOD = {
    "py": ["", "x = 1\n", "def f(a, *b, c=1, **d) -> int:\n    return a\n", "class A(B, m=C):\n  x: int = 3\n  @p\n  async def f(self): yield await x\n", "a = [x for y in z if x for w in v]\nwith open(a) as b, c: pass\n", "match x:\n  case [1, *r] if r: pass\n  case {'a': b} | C(d=e): pass\n", "x = f'{a!r:>{w}} {\"q\"}' 'b'\n", "try: a\nexcept* E as e: b\nfinally: c\n", "if (n := 3) > 2: print(*a, **b)\nelif 1: ...\nelse: pass\n", "s = '''<<<<<<< HEAD\n'''\n"],
    "js": ["", "import a, { b as c } from 'x';\nexport default async () => {}\n", "const re = /[/]x/g.test(a) ? a / b / c : d\nlet y = 1\n", "class A extends B { static #x = 1; get y() { return 1 } async *z() {} static { a() } }", "for (const [k, v] of Object.entries(o)) if (k) continue; else break", "x = `a ${b + `c ${d}`} e`; label: while (1) { break label }", "(()=>{var e={};for(var a=0;a<2;a++)o+=n[a];if(c&&!u){t=\"x\"}else t=void 0})();", "a?.b?.[c]?.(d) ?? e; x ||= 1; import('y').then(z => z)"],
    "ts": ["interface A<T> extends B { a?: string; [k: string]: any; f(x: number): void }", "export abstract class A<T = {}> implements I { constructor(private readonly a: string) { super() } abstract f(): void; x!: number }", "type F<T> = T extends (infer U)[] ? U : never; enum E { A = 1, B }", "function f(this: X, a?: number, ...b: string[]): a is string { return a as unknown as any }", "if (a) b\nelse c\nlet m = new Map<string, Array<number>>()", "declare module 'x' { export function y(a: number): void }"],
    "go": ["package a\n", "package a\nimport (\n\t\"x\"\n\ty \"z\"\n)\nfunc (t *T) F(a, b int, c ...string) (r int, err error) {\n\tif v, ok := m[a]; ok {\n\t\treturn v, nil\n\t}\n\tfor i, v := range xs {\n\t\t_ = v\n\t}\n\tswitch {\n\tcase a > b:\n\tdefault:\n\t}\n\treturn\n}\n", "package a\ntype T[K comparable] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\nvar x = map[string][]int{\"a\": {1, 2}}\n"],
    "java": ["", "package a.b;\nimport static c.D.*;\npublic class A<T extends B & C> { int[] x = {1, 2}; <V> V f(final V... v) throws E { for (int i = 0; i < 3; i++) { x[i] >>>= 2; } return (V) (Object) v; } }", "record P(int x) { P { if (x < 0) throw new E(); } } enum E { A(1) { }, B; E() {} } @interface N { int v() default 1; }", "class A { void f() { var x = switch (d) { case M, N -> 6; default -> { yield 7; } }; Runnable r = () -> {}; List<String> l = ArrayList::new; if (a instanceof String s && s.isEmpty()) { } } }"],
}
BAD = {
    "py": ["def f(:\n    pass\n", "def f():\n", "x = (1,\n", "if a:\n  b\n c\n", "<<<<<<< HEAD\nx = 1\n", "'''open", "f() = 3\n", "import a from b\n", "x = 1 y = 2\n", "class A {\n}\n", "return = 3\n"],
    "js": ["import { a, type B } from './x';", "let q: string = 1", "f(a b)", "const x = 'abc", "x = `a", "function f( {", "a {", "<!DOCTYPE html>", "{ a", "/* open", "package x\n", "let x = 1 let y = 2", ">>>>>>> main\nx()"],
    "ts": ["interface A { x: string y: number }", "const x: = 1", "class A { f(a: ) {} }", "def f(): pass", "type A = ;", "try { a() }"],
    "go": ["", "package x\nfoo()\n", "import \"x\"\n", "package x\nfunc f() { a := }\n", "package x\nfunc f() { foo(\n a\n) }\n", "package x\nfunc f() {\n=======\n}\n"],
    "java": ["class A {", "class A { void f() { int x = 1 } }", "class A { x = 1; }", "package x\nimport y", "class A { char c = ''; }", "class A { try { } finally { } }"],
}


@pytest.mark.parametrize("ext", GOOD)
def test_valid(ext):
    for text in GOOD[ext]:
        assert syntax.check(text, ext) is None, text
        assert syntax.check(text.replace("\n", "\r\n"), ext) is None, text


@pytest.mark.parametrize("ext", BAD)
def test_invalid(ext):
    for text in BAD[ext]:
        assert syntax.check(text, ext) is not None, text


def test_python_against_the_standard_parser():
    import lodestone

    rnd = random.Random(7)
    import os

    lang = language("python")
    base = os.path.dirname(lodestone.__file__)
    sources = [open(os.path.join(d, n), encoding="utf-8").read() for d, _, ns in os.walk(base) for n in ns if n.endswith(".py")]
    for text in sources:
        assert lang.valid(text)
        lines = text.split("\n")
        for _ in range(6):  # truncated anywhere, or a line less
            cut = text[: rnd.randrange(len(text) + 1)] if rnd.random() < 0.5 else "\n".join(lines[: (k := rnd.randrange(len(lines)))] + lines[k + 1 :])
            try:
                ast.parse(cut)
                want = True
            except SyntaxError:
                want = False
            except ValueError:
                continue
            assert lang.valid(cut) == want, cut[-200:]


def test_causes_and_lines():
    assert syntax.check("x = 1\n<<<<<<< HEAD\ny = 2\n=======\ny = 3\n>>>>>>> b\n", "py") == ("conflict", 2)
    assert syntax.check("package a\n\nfunc f() {\n\tx()\n", "go")[0] == "truncated"
    assert syntax.check("package a\n\nfunc f(a int) {\n\tx(a)\n\ty := 1\n}\n", "py")[0] == "other_language"
    assert syntax.check("a();\nb();\nc(1 2);\nd();\ne();\n", "js") == ("syntax", 3)


def test_memo_is_the_same_in_any_order():
    texts = [t for ext in ("js",) for t in GOOD[ext] + BAD[ext]]
    lang = language("javascript")
    want = [lang.valid(t) for t in texts]
    order = list(range(len(texts))) * 3
    random.Random(1).shuffle(order)
    assert all(lang.valid(texts[i]) == want[i] for i in order)


def test_a_full_memo_is_emptied_and_what_still_fails_is_unjudged(monkeypatch):
    grammar = language("javascript").grammar
    monkeypatch.setattr(peg, "ROOM", 40)
    text = "".join(f"f({'a,' * n}a);\n" for n in range(30))
    grammar.fresh(at_once=True)
    for n in range(35):  # what the worker parsed before takes nearly all of the room
        grammar.group("P", "x" * n)
    monkeypatch.setattr(grammar, "next", dict(grammar.next))
    fresh = type(grammar).fresh
    monkeypatch.setattr(grammar, "fresh", lambda at_once=False: fresh(grammar, True) if at_once else None)  # 20,000 are more than this room
    assert syntax.check(text, "js") is None
    with pytest.raises(syntax.Unjudged):
        syntax.check("".join(f"f({'a,' * n}a);\n" for n in range(60)), "js")
    fresh(grammar, True)


def test_unjudged_files_arent_counted(spark):
    deep = "x = " + "not " * 100_000 + "1\n"
    F_ = spark.createDataFrame([("/r/a.py", "a.py", "py", None, "r", None), ("/r/b.py", "b.py", "py", None, "r", None)], SCANNED)
    C_ = spark.createDataFrame([("/r/a.py", 1, deep), ("/r/b.py", 1, "x = 1")], "filepath string, startline int, content string")
    j = syntax.judge_files(F_, C_)
    assert rows(j, "path", "judged", "cause") == [("/r/a.py", False, None), ("/r/b.py", True, None)]
    assert rows(syntax.rates(j)) == [("r", "python", 1, 0, 0.0)]


def test_assemble():
    p = lambda *xs: [dict(s=s, c=c) for s, c in xs]
    assert files.assemble(p((4, "c"), (1, "a\nb"))) == "a\nb\n\nc" and files.assemble(p((1, "a\n"), (2, "b"))) == "a\nb"
    assert files.assemble(p((3, "x"))) == "\n\nx" and files.assemble(p((1, None))) is None and files.assemble(None) is None and files.assemble([]) is None


SCANNED = "path string, relativepath string, extension string, language string, repo string, cause string"


def test_judge_files_and_rates(spark):
    f = [("/r/a.py", "a.py", ".PY", None, "r", "x"), ("/r/a.py", "a.py", ".PY", None, "r", "x"), ("/r/b.py", "b.py", "py", "Python", "r", None), ("/r/c.ts", "c.ts", "ts", None, "r", None), ("/r/d.txt", "d", "txt", None, "r", None), (None, None, "py", None, None, None), ("/r/e.go", "e", "go", "go", "r", None)]
    c = [("/r/a.py", 1, "def f("), ("/r/b.py", 1, "x = 1"), ("/r/b.py", 1, "x = 1"), ("/r/b.py", 4, "y = 2"), ("/r/c.ts", 1, None), ("/r/zz.py", 1, "(")]
    F_ = spark.createDataFrame(f, SCANNED)
    C_ = spark.createDataFrame(c, "filepath string, startline int, content string")
    j = syntax.judge_files(F_, C_)
    assert rows(j, "path", "judged", "cause") == [("/r/a.py", True, "truncated"), ("/r/b.py", True, None), ("/r/c.ts", False, None), ("/r/e.go", False, None)]
    assert rows(syntax.rates(j)) == [("r", "python", 2, 1, 0.5)]
    assert syntax.judge_files(F_.limit(0), C_).count() == 0


HAND = "import { a } from './a';\n\nexport function run(items: Item[]): Item[] {\n  for (const item of load(items)) {\n    if (!item.ok) continue;\n    items.push(item);\n  }\n  const total = count(items, 3);\n  try {\n    flush(items);\n  } catch (err) {\n    log.warn('late', err);\n  }\n  return items;\n}\n"


@pytest.mark.parametrize(("path", "ext", "text", "kind"), [
    ("src/a.ts", "ts", HAND, None), ("third_party/lib/a.ts", "ts", HAND, "vendored"), ("src/lib/kit-1.2.3/a.ts", "ts", HAND, "vendored"), ("src/vendors/a.ts", "ts", HAND, None), ("vendor/a.ts", "ts", HAND, None),
    ("src/a.ts", "ts", "// Code generated by x v1. DO NOT EDIT.\n" + HAND, "generated"), ("src/a.ts", "ts", "// Copyright 2020 us\n// All rights reserved.\n//\n// Generated on 2025-01-01 from a.yaml using gen v2\n" + HAND, "generated"),
    ("src/a.ts", "ts", "// Vendored copy of kit 1.2, upstream https://kit.example\n" + HAND, "vendored"), ("src/a.ts", "ts", "// Lists which files were generated, so that the scanner can skip them.\n" + HAND, None),
    ("src/a.ts", "ts", HAND + "const banner = 'Code generated by x. DO NOT EDIT.';\n", None), ("src/a.ts", "ts", "// " + "a very long remark " * 60 + "\n" + HAND, None),
    ("a.js", "js", "(()=>{" + "var e={},t=[];for(var a=0;a<9;a++)o+=n[a];if(c&&!u){t=1}else t=2;" * 20 + "})();", "minified"), ("a.py", "py", "DATA = [\n" + "  12, 345, 6789, 1011, 12131,\n" * 60 + "]\n", "data"),
    ("a.js", "js", "".join(f"A.prototype.get{i} = function () {{ return B.get(this, {i}); }};\n" for i in range(30)), "generated"), ("a.ts", "ts", None, None), ("a.ts", "ts", "", None), ("node_modules/x/a.json", "json", "{}", "vendored"), ("c.yaml", "yaml", "a: 1\n" * 100, None),
])
def test_provenance(path, ext, text, kind):
    assert provenance.judge(path, ext, text).kind == kind


LICENCE = "".join(f"// {i}. The licensee may use this text under the terms of paragraph {i}.\n" for i in range(40))
CODEGEN = "Code generated by protomill v1. DO NOT EDIT."


@pytest.mark.parametrize(("ext", "text", "kind"), [
    ("ts", HAND + f"// {CODEGEN}\n", "generated"), ("ts", HAND + "\n// Generated on 2025-01-01 from a.yaml using gen v2", "generated"), ("ts", LICENCE + f"// {CODEGEN}\n" + HAND, "generated"), ("ts", LICENCE * 5 + "/*\n  Vendored copy of kit 1.2\n*/\n" + HAND, "vendored"),
    ("py", f'"""Tables of the parser.\n\n{CODEGEN}\n"""\n\nx = 1\n', "generated"), ("py", "def f():\n    return 1\n# @generated by apistamp v0.1\n", "generated"), ("py", f"# {CODEGEN}\nx = 1\n", "generated"), ("go", f"package a\n\n// {CODEGEN}\nvar x = 1\n", "generated"),
    ("java", HAND.replace("import { a } from './a';", "class A {}") + f"/** {CODEGEN} */", "generated"), ("ts", HAND.replace("  try {", f"  // {CODEGEN}\n  try {{"), "generated"), ("yaml", "a: 1\n" * 30 + f"# {CODEGEN}\n", "generated"),
    ("yaml", f"run: |\n  # {CODEGEN}\n  true\nb: 2\n", None), ("ts", HAND + f"const banner = `\n// {CODEGEN}\n`;\n", None), ("py", f'banner = """\n# {CODEGEN}\n"""\n', None), ("ts", HAND.replace("  try {", "  // ids are generated by uuid\n  try {"), None),
    ("py", "def f():\n    # skips files that say 'Code generated by x. DO NOT EDIT.'\n    return 1\n", None), ("ts", HAND.replace("  try {", "  // falls back to the vendored copy of the table\n  try {"), None),
])
def test_marks_are_read_in_the_whole_file(ext, text, kind):
    assert provenance.judge("src/a." + ext, ext, text).kind == kind


def test_copies_of_vendored_files(spark):
    f = spark.createDataFrame([("/r/third_party/k/a.ts", "third_party/k/a.ts", "ts", None, "r", None), ("/s/src/b.ts", "src/b.ts", "ts", None, "s", None), ("/s/src/c.ts", "src/c.ts", "ts", None, "s", None), ("/s/src/c.ts", "src/c.ts", "ts", None, "s", None)], SCANNED)
    c = spark.createDataFrame([("/r/third_party/k/a.ts", 1, HAND), ("/s/src/b.ts", 1, "// moved here\n" + HAND), ("/s/src/c.ts", 1, HAND.replace("run", "walk"))], "filepath string, startline int, content string")
    assert rows(provenance.find_foreign(f, c), "path", "kind") == [("/r/third_party/k/a.ts", "vendored"), ("/s/src/b.ts", "vendored")]
    assert provenance.find_foreign(f.limit(0), c).count() == 0


def test_short_copies_must_be_equal_as_a_whole(spark):
    f = spark.createDataFrame([(f"/{r}/a.js", p, "js", None, r, None) for r, p in (("x", "third_party/k/a.js"), ("y", "src/a.js"), ("z", "src/b.js"))], SCANNED)
    c = spark.createDataFrame([("/x/a.js", 1, "// tiny\nexport default 1;\n"), ("/y/a.js", 1, "// tiny\nexport default 1;\n"), ("/z/a.js", 1, "export default 1;\n")], "filepath string, startline int, content string")
    assert rows(provenance.find_foreign(f, c), "path", "evidence") == [("/x/a.js", "place"), ("/y/a.js", "copy")]


@pytest.mark.parametrize(("ext", "text", "kind"), [
    ("js", "var a=1,b=2;function f(c){return a+b*c}for(var i=0;i<9;i++){f(i)}module.exports={f:f,a:a};if(a){b()}else{c()}", "minified"),  # one line of 110 characters
    ("js", "const a = 1;\n", None), ("py", "import os\n", None), ("py", 'x = "' + "q8Zr" * 30 + '"\n', "data"), ("ts", "const MESSAGES = { saved: 'Your work is saved', failed: 'It could not be saved' };\n", None),
    ("go", "package m\n\nimport (\n\t\"log\"\n\t\"a.example/b\"\n\t\"a.example/c\"\n\t\"a.example/d\"\n\t\"a.example/e\"\n)\n\nfunc F(a int) int {\n\treturn g(a)\n}\n", None),
    ("ts", "".join(f"- move the {w} to the shelf, then close it\n" for w in "abcdefghijklmnopqrstuvwxyz"), None),
    ("java", "class A {\n" + "".join(f"  public int get{i}() {{ return f{i}; }}\n  public A set{i}(int v) {{ f{i} = v; return this; }}\n" for i in range(9)) + "}\n", "generated"),
])
def test_layout_tells_at_any_size(ext, text, kind):
    j = provenance.judge("src/a." + ext, ext, text)
    assert j.kind == kind and j.evidence == ("layout" if kind else None)


@pytest.mark.parametrize(("ext", "text", "lines"), [
    ("js", "for(var i=0;i<9;i++){f({a:1,b:[2,3]})}if(x){y()}else{z()}", ["for (var i = 0; i < 9; i++) {", "f({ a: 1, b: [2, 3] })", "}", "if (x) {", "y()", "} else {", "z()", "}"]),
    ("py", "if a: return 1\nx={'k':[1,\n 2]}; y = 3\n", ["if a:", "return 1", "x = { 'k': [1, 2] };", "y = 3"]),
    ("go", "package a\nfunc f() T {\n\tx := T{1, 2}\n\treturn x\n}\n", ["package a", "func f() T {", "x := T { 1, 2 }", "return x", "}"]),
])
def test_canonical_text(ext, text, lines):
    lang = language(EXTENSIONS[ext])
    got = ["".join((" " if k and provenance._blank(*(provenance.shape(x, lang.keywords) for x in line[k - 1 : k + 1])) else "") + t for k, t in enumerate(line)) for line in provenance.emit(lang.lex(text), lang)]
    assert got == lines


def test_every_extension_has_a_language():
    assert all(language(x).name == x for x in set(EXTENSIONS.values()))


def test_a_failure_of_the_parser_is_no_cause(spark, monkeypatch):
    deep = "x = " + "not " * 100_000 + "1\n"  # no JavaScript; whether it is Python the parser can't tell
    assert syntax.check(deep, "js") == ("unknown", 1)
    assert syntax.check("a();\nb();\nc(1 2);\nd();\ne();\n", "js") == ("syntax", 3)

    def fails(text):
        raise RecursionError

    monkeypatch.setattr(language("javascript"), "failure", fails)
    assert syntax.check("a();\nb();\nc(1 2);\nd();\ne();\n", "js") == ("unknown", None)
