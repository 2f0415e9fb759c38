"""From a file's text to its chunks, symbols, imports, calls and tags.

Python is read with the standard library's parser; TypeScript, JavaScript, Go, Java, Rust and other brace languages by their
declarations and matching braces, on text in which strings and comments are blanked out. Whatever can't be read becomes one
chunk. Extraction is a narrow, Arrow-batched pass that gives one row a file, with arrays that explode into the tables.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import MAX_CHUNK_TOKENS
from lodestone.operators.calls import CALL_NOISE

_CHUNK = "struct<id:string,name:string,type:string,content:string,signature:string,startLine:int,endLine:int>"
_SYMBOL = "struct<id:string,name:string,qualified_name:string,kind:string,start_line:int,end_line:int,signature:string,parent_symbol:string,visibility:string,parameters:array<struct<name:string,type:string,defaultValue:string>>,return_type:string>"
_IMPORT = "struct<source_path:string,symbols:array<string>,line:int>"
_CALL = "struct<caller_symbol:string,caller_line:int,callee_name:string>"
_TAG = "struct<name:string,kind:string,line:int>"
SCHEMA = f"path string, language string, chunks array<{_CHUNK}>, symbols array<{_SYMBOL}>, imports array<{_IMPORT}>, calls array<{_CALL}>, tags array<{_TAG}>"

_BLANK = re.compile(r"//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_DECL = re.compile(
    r"^(?P<export>(?:export\s+(?:default\s+)?|pub(?:\([^)]*\))?\s+|public\s+)?)(?P<mods>(?:(?:declare|abstract|async|static|final|private|protected|internal|sealed|open|data|unsafe|const|partial|override|public)\s+)*)"
    r"(?:(?P<func>function\s*\*?|func|fn|fun|def)\s+(?:\([^)]*\)\s*)?(?P<fname>[A-Za-z_$][\w$]*)|(?P<kind>class|interface|enum|struct|trait|impl|record|object|namespace|module|type)\s+(?P<kname>[A-Za-z_$][\w$]*)"
    r"|(?:const|let|var)\s+(?P<vname>[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?P<arrow>(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=\n]+)?=>|[A-Za-z_$][\w$]*\s*=>)))"
)
_MEMBER = re.compile(
    r"^\s+(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|async|override|final|synchronized|get|set|declare)\s+)*)(?:(?P<ret>[A-Za-z_][\w<>\[\], .?]*)\s+)?\*?(?P<name>#?[A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\s*(?P<rest>[(:=;?!])"
)
_KINDS = {"class": "class", "interface": "interface", "enum": "enum", "type": "type", "struct": "class", "trait": "interface", "record": "class", "object": "class", "impl": "class"}
_CALLEE = re.compile(r"(?:\.|\b)([A-Za-z_$][\w$]*)\s*(?:<[\w, ]+>)?\(")
_NOT_CALLS = frozenset("if for while switch catch return function func fn def new typeof await async class super this constructor else do try throw yield import export in of instanceof match range make len append cap delete".split())
_TS_IMPORT = re.compile(r"(?m)^\s*import\s+(?P<type>type\s+)?(?P<what>[^'\";]*?)\s*(?:from\s*)?(?P<q>['\"])(?P<src>[^'\"\n]+)(?P=q)")
_REQUIRE = re.compile(r"(?m)^\s*(?:(?:const|let|var)\s+[^=\n]+=\s*)?require\(\s*(['\"])([^'\"\n]+)\1\s*\)")
_REEXPORT = re.compile(r"(?m)^\s*export\s+(?:type\s+)?(?P<what>\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*(['\"])(?P<src>[^'\"\n]+)\2")


def whole_file(path: str, text: str) -> dict:
    lines = text.split("\n")
    return dict(id=f"{path}:1-{len(lines)}", name=path.rsplit("/", 1)[-1], type="module", content=text, signature=lines[0].strip()[:120], startLine=1, endLine=len(lines))


def _chunk(path: str, lines: list[str], a: int, b: int, name: str, kind: str) -> dict:
    body = "\n".join(lines[a - 1 : b])
    return dict(id=f"{path}:{a}-{b}", name=name, type=kind, content=body, signature=lines[a - 1].strip()[:120], startLine=a, endLine=b)


def _symbol(path, lines, a, b, name, kind, parent=None, visibility="internal", params=None, ret=None) -> dict:
    qualified = f"{parent}.{name}" if parent else name
    # The start line makes ids of overloads differ.
    return dict(id=f"{path}#{qualified}@{a}", name=name, qualified_name=qualified, kind=kind, start_line=a, end_line=b, signature=lines[a - 1].strip()[:200], parent_symbol=parent, visibility=visibility, parameters=params, return_type=ret)


def _params(text: str) -> list[dict] | None:
    out, depth, part = [], 0, ""
    for c in text + ",":
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        if c == "," and depth <= 0:
            p = part.strip()
            part = ""
            if not p or p in ("self", "this"):
                continue
            left, _, default = p.partition("=") if "=>" not in p else (p, "", "")
            name, _, kind = left.partition(":")
            name = re.sub(r"^(?:(?:public|private|protected|readonly|final)\s+)+", "", name.strip()).rstrip("?").lstrip(".")
            if name and name not in ("self", "this"):
                out.append(dict(name=name.strip(), type=kind.strip() or None, defaultValue=default.strip() or None))
        else:
            part += c
    return out or None


def _close(masked: str, at: int) -> int:
    """The position of the brace that closes the first one after `at`; the line's end if there is none before it ends."""
    stop = masked.find("\n", at)
    stop = len(masked) if stop < 0 else stop
    first = masked.find("{", at)
    semi = masked.find(";", at)
    if first < 0 or 0 <= semi < first:
        return semi if 0 <= semi else stop
    depth = 0
    for m in re.compile(r"[{}]").finditer(masked, first):
        depth += 1 if m.group(0) == "{" else -1
        if depth == 0:
            return m.start()
    return len(masked)


def _paren(masked: str, text: str, at: int) -> tuple[str, int]:
    first = masked.find("(", at)
    if first < 0:
        return "", at
    depth = 0
    for m in re.compile(r"[()]").finditer(masked, first):
        depth += 1 if m.group(0) == "(" else -1
        if depth == 0:
            return text[first + 1 : m.start()], m.end()
    return "", at


def _calls(masked_body: str, first_line: int, caller: str) -> list[dict]:
    out, seen = [], set()
    for m in _CALLEE.finditer(masked_body):
        name = m.group(1)
        if name in _NOT_CALLS or name in CALL_NOISE or (caller, name) in seen:
            continue
        seen.add((caller, name))
        out.append(dict(caller_symbol=caller, caller_line=first_line + masked_body.count("\n", 0, m.start(1)), callee_name=name))
    return out


def _imported(what: str) -> list[str]:
    what = what.strip()
    if not what:
        return ["*"]
    names = []
    if m := re.search(r"\{([^}]*)\}", what):
        names += [re.sub(r"^type\s+", "", p.strip()).split(" as ")[0].strip() for p in m.group(1).split(",") if p.strip()]
        what = what[: m.start()] + what[m.end() :]
    for p in what.split(","):
        p = p.strip()
        if p.startswith("*"):
            names.append("*")
        elif p:
            names.insert(0, "default")
    return names or ["*"]


def imports_of(text: str, language: str | None) -> list[dict]:
    """Import statements, requires and re-exports of JavaScript's family; others have none here."""
    found = []
    line = lambda m: text.count("\n", 0, m.start()) + 1 + (len(m.group(0)) - len(m.group(0).lstrip("\n")))
    for m in _TS_IMPORT.finditer(text):
        found.append(dict(source_path=m.group("src"), symbols=_imported(m.group("what")), line=line(m)))
    for m in _REQUIRE.finditer(text):
        found.append(dict(source_path=m.group(2), symbols=["*"], line=line(m)))
    for m in _REEXPORT.finditer(text):
        what = m.group("what")
        found.append(dict(source_path=m.group("src"), symbols=["*"] if what.startswith("*") else _imported(what), line=line(m)))
    return sorted(found, key=lambda r: r["line"])


def extract_braces(path: str, text: str, language: str | None) -> dict | None:
    masked = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), text)
    lines = text.split("\n")
    starts = [0]
    for ln in lines:
        starts.append(starts[-1] + len(ln) + 1)
    line_of = lambda pos: text.count("\n", 0, pos) + 1
    chunks, symbols, calls, tags = [], [], [], []
    i = 0
    flat = masked.split("\n")
    while i < len(flat):
        m = _DECL.match(flat[i])
        if not m:
            i += 1
            continue
        at = starts[i]
        end = _close(masked, at)
        b = min(line_of(min(end, len(text) - 1 if text else 0)), len(lines))
        name = m.group("fname") or m.group("kname") or m.group("vname")
        kind = "function" if m.group("func") or m.group("vname") else _KINDS.get(m.group("kind"), "type")
        go_public = language == "go" and name[:1].isupper()
        visibility = "exported" if m.group("export") or go_public else "internal"
        params = ret = None
        if kind == "function":
            inside, after = _paren(masked, text, at + (m.start("fname") if m.group("fname") else m.start("arrow") if m.group("vname") else 0))
            params = _params(inside)
            r = re.match(r"\s*(?:->|:)\s*([^{=;\n]+?)\s*(?:\{|=>|;|$)", text[after : after + 200])
            ret = r.group(1).strip() if r else None
            calls += _calls(masked[masked.find("{", at) if 0 <= masked.find("{", at) < end else after : end], line_of(masked.find("{", at) if 0 <= masked.find("{", at) < end else after), name)
        symbols.append(_symbol(path, lines, i + 1, b, name, kind, None, visibility, params, ret))
        chunks.append(_chunk(path, lines, i + 1, b, name, kind if kind in ("function", "class") else "type"))
        tags.append(dict(name=name, kind="def", line=i + 1))
        if kind in ("class", "interface"):
            depth = flat[i].count("{") - flat[i].count("}")
            j = i + 1
            while j < b:
                row = flat[j]
                mm = _MEMBER.match(row) if depth == 1 else None
                if mm and mm.group("name") not in _NOT_CALLS - {"constructor"} and not row.strip().startswith(("}", "return ", "@")):
                    member = mm.group("name")
                    if mm.group("rest") == "(":
                        stop = _close(masked, starts[j])
                        e = min(max(line_of(min(stop, max(len(text) - 1, 0))), j + 1), b)
                        inside, after = _paren(masked, text, starts[j] + mm.start("name"))
                        r = re.match(r"\s*:\s*([^{;\n]+?)\s*[{;\n]", text[after : after + 200] + "\n")
                        symbols.append(_symbol(path, lines, j + 1, e, member, "method", name, visibility, _params(inside), r.group(1).strip() if r else None))
                        calls += _calls(masked[after:stop], line_of(after), member)
                        depth += sum(x.count("{") - x.count("}") for x in flat[j:e])
                        j = e
                        continue
                    if kind == "class" or mm.group("rest") in ":?":
                        symbols.append(_symbol(path, lines, j + 1, j + 1, member, "field", name, visibility))
                depth += row.count("{") - row.count("}")
                j += 1
        i = max(i + 1, b)
    found = imports_of(text, language) if language in ("typescript", "tsx", "javascript", "jsx") else []
    tags += [dict(name=s, kind="ref", line=r["line"]) for r in found for s in r["symbols"] if re.match(r"[A-Za-z_$]", s) and s != "default"]
    if not chunks:
        return dict(chunks=[whole_file(path, text)], symbols=[], imports=found, calls=[], tags=tags)
    return dict(chunks=chunks, symbols=symbols, imports=found, calls=calls, tags=tags)


def extract_python(path: str, text: str) -> dict | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    lines = text.split("\n")
    chunks, symbols, imports, calls, tags = [], [], [], [], []

    def show(node) -> str | None:
        return ast.unparse(node) if node is not None else None

    def params(a: ast.arguments) -> list[dict] | None:
        pos = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(pos) - len(a.defaults)) + list(a.defaults)
        out = [dict(name=p.arg, type=show(p.annotation), defaultValue=show(d)) for p, d in zip(pos, defaults)]
        out += [dict(name=p.arg, type=show(p.annotation), defaultValue=show(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults)]
        return [p for p in out if p["name"] not in ("self", "cls")] or None

    def span(node) -> tuple[int, int]:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        return first, node.end_lineno

    def called(node, caller: str) -> None:
        seen = set()
        for n in ast.walk(node):
            if isinstance(n, ast.Call):
                name = n.func.id if isinstance(n.func, ast.Name) else n.func.attr if isinstance(n.func, ast.Attribute) else None
                if name and name not in CALL_NOISE and name not in seen:
                    seen.add(name)
                    calls.append(dict(caller_symbol=caller, caller_line=n.lineno, callee_name=name))

    for node in tree.body:
        a, b = span(node)
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            cls = isinstance(node, ast.ClassDef)
            seen = "internal" if node.name.startswith("_") else "exported"
            chunks.append(_chunk(path, lines, a, b, node.name, "class" if cls else "function"))
            tags.append(dict(name=node.name, kind="def", line=a))
            symbols.append(_symbol(path, lines, a, b, node.name, "class" if cls else "function", None, seen, None if cls else params(node.args), None if cls else show(node.returns)))
            if not cls:
                called(node, node.name)
                continue
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    x, y = span(m)
                    symbols.append(_symbol(path, lines, x, y, m.name, "method", node.name, seen, params(m.args), show(m.returns)))
                    called(m, m.name)
                elif isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name):
                    symbols.append(_symbol(path, lines, m.lineno, m.end_lineno, m.target.id, "field", node.name, seen))
                elif isinstance(m, ast.Assign) and isinstance(m.targets[0], ast.Name):
                    symbols.append(_symbol(path, lines, m.lineno, m.end_lineno, m.targets[0].id, "field", node.name, seen))
        elif isinstance(node, ast.ImportFrom):
            names = [n.name for n in node.names]
            tags += [dict(name=n, kind="ref", line=a) for n in names if n != "*"]
            if node.level:
                rest = (node.module or "").replace(".", "/")
                base = "./" if node.level == 1 else "../" * (node.level - 1)
                imports.append(dict(source_path=base + rest, symbols=names or ["*"], line=a))
    if not chunks:
        return dict(chunks=[whole_file(path, text)], symbols=[], imports=imports, calls=[], tags=tags)
    return dict(chunks=chunks, symbols=symbols, imports=imports, calls=calls, tags=tags)


def _split_large(path: str, chunk: dict) -> list[dict]:
    """A chunk over the limit in pieces that end between its lines of least indentation."""
    if len(chunk["content"]) <= MAX_CHUNK_TOKENS * 4:
        return [chunk]
    lines = chunk["content"].split("\n")
    out, a, size = [], 0, 0
    for i, ln in enumerate(lines):
        if size + len(ln) + 1 > MAX_CHUNK_TOKENS * 4 and i > a:
            cut = next((j for j in range(i, a, -1) if lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= 4), i)
            out.append((a, cut))
            a, size = cut, sum(len(x) + 1 for x in lines[cut:i])
        size += len(ln) + 1
    out.append((a, len(lines)))
    first = chunk["startLine"]
    return [dict(chunk, id=f"{path}:{first + x}-{first + y - 1}", content="\n".join(lines[x:y]), startLine=first + x, endLine=first + y - 1, signature=lines[x].strip()[:120]) for x, y in out if y > x]


# Words of import statements that are no names, wherever they stand in one.
IMPORT_NOISE = frozenset("import from as type typeof crate self super".split())
_PATH_IMPORT = re.compile(r"(?m)^\s*(?:pub\s+)?(?:import(?:\s+static)?|use)\s+(?P<path>[\w.:{}, *\n]+?)\s*;")


def import_refs(text: str, language: str | None) -> list[dict]:
    """Tags of kind ref for the names that a file's import statements bring in: the names that the other file gives them, not
    their local aliases; a default import counts by its local name. Whole-module imports, paths and IMPORT_NOISE are left out."""
    found: list[tuple[str, int]] = []
    if language in ("rust", "java", "kotlin", "scala"):
        for m in _PATH_IMPORT.finditer(text):
            path = re.sub(r"\bas\s+\w+", " ", m.group("path"))
            found += [(w, text.count("\n", 0, m.start("path")) + 1) for w in re.findall(r"\w+", path)]
    elif language in ("typescript", "tsx", "javascript", "jsx", "vue", "svelte"):
        for m in _TS_IMPORT.finditer(text):
            what = re.sub(r"\*\s*as\s+\w+", "", m.group("what"))
            names = [p.strip().removeprefix("type ").split(" as ")[0].strip() for p in re.sub(r"[{}]", ",", what).split(",")]
            found += [(n, text.count("\n", 0, m.start("what")) + 1) for n in names]
    return [dict(name=n, kind="ref", line=a) for n, a in dict.fromkeys(found) if n not in IMPORT_NOISE and re.match(r"[A-Za-z_$]", n)]


BRACES = frozenset("typescript tsx javascript jsx go java rust c cpp c_sharp kotlin scala swift dart php vue svelte".split())


def extract_one(path: str, text: str, language: str | None) -> dict:
    found = None
    try:
        if language == "python":
            found = extract_python(path, text)
        elif language in BRACES:
            found = extract_braces(path, text, language)
    except (ValueError, IndexError, RecursionError):
        found = None
    found = found or dict(chunks=[whole_file(path, text)], symbols=[], imports=[], calls=[], tags=[])
    known = {(t["name"], t["line"]) for t in found["tags"] if t["kind"] == "ref"}
    found["tags"] = found["tags"] + [t for t in import_refs(text, language) if (t["name"], t["line"]) not in known]
    found["chunks"] = [p for c in found["chunks"] for p in _split_large(path, c)]
    return found


def extract(files: DataFrame) -> DataFrame:
    """SCHEMA, one row a file of files (path, content, language). Null contents are dropped; an empty text is one empty chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [dict(path=p, language=lang, **extract_one(p, t, lang)) for p, t, lang in zip(pdf["path"], pdf["content"], pdf["language"])]
            yield pd.DataFrame(rows, columns=["path", "language", "chunks", "symbols", "imports", "calls", "tags"])

    return files.select("path", "content", "language").where("path is not null and content is not null").mapInPandas(run, SCHEMA)


def chunks_of(extracted: DataFrame) -> DataFrame:
    c = extracted.select("path", "language", F.explode("chunks").alias("c"))
    return c.select("c.id", F.col("path").alias("filePath"), F.col("c.name").alias("chunkName"), F.col("c.type").alias("chunkType"), "c.startLine", "c.endLine", "c.content", "c.signature", "language")


def symbols_of(extracted: DataFrame) -> DataFrame:
    s = extracted.select("path", "language", F.explode("symbols").alias("s"))
    fields = ["id", "name", "qualified_name", "kind"]
    return s.select(*[f"s.{f}" for f in fields], F.col("path").alias("file_path"), "s.start_line", "s.end_line", "s.signature", "s.parent_symbol", "s.visibility", "language", "s.parameters", "s.return_type")


def imports_of_files(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("path").alias("from_file"), F.explode("imports").alias("i")).select("from_file", "i.source_path", "i.symbols", "i.line")


def calls_of(extracted: DataFrame) -> DataFrame:
    c = extracted.select(F.col("path").alias("caller_file"), F.explode("calls").alias("c"))
    return c.select("caller_file", "c.caller_symbol", "c.caller_line", "c.callee_name", F.lit(None).cast("string").alias("callee_file"))


def tags_of(extracted: DataFrame) -> DataFrame:
    """(name, kind, file, line, seq); seq orders definitions by file and line."""
    t = extracted.select(F.col("path").alias("file"), F.posexplode("tags").alias("n", "t"))
    return t.select("t.name", "t.kind", "file", "t.line", (F.col("t.line").cast("bigint") * 100_000 + F.col("n")).alias("seq"))
