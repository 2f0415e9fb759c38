"""Lexers and parsing expression grammars of Python 3, JavaScript, TypeScript, Go and Java.

The grammars state what the languages' published syntax allows. Early errors that need more than syntax (names, duplicate
declarations, types) are left to compilers. In brace languages a line end is a token only where it can end a statement.
"""

from __future__ import annotations

import re
from functools import lru_cache

from lodestone.llm.peg import ERROR, Grammar, Vocabulary

KINDS = {"ident": "i", "num": "n", "str": "s", "regex": "x", "template": "t", "nl": "N", "annot": "@"}
_RUN = re.compile("NN+")
_OPEN = {"(": ")", "[": "]", "{": "}"}
_GROUP = {"(": "P", "[": "K", "{": "B"}

_IDENT = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d[\d_]*)?)"
_DQ = r'"(?:[^"\\\n]|\\[\s\S])*"'
_SQ = r"'(?:[^'\\\n]|\\[\s\S])*'"


class Language:
    """A lexer and a grammar; check() parses a whole source."""

    def __init__(self, name: str, pattern: str, keywords: str, ops: str, grammar: str, start: str, sets: dict[str, list[str]] | None = None):
        self.name, self.start = name, start
        self.rx = re.compile(pattern)
        self.voc = Vocabulary(KINDS)
        self.keywords = frozenset(keywords.split())
        self.ops = frozenset(ops.split())
        sets = sets or {}
        for t in sorted(self.keywords | self.ops):
            self.voc.token(t)
        self.grammar = Grammar(grammar, self.voc, sets)
        self.code: dict[str, str] = {}
        for t in self.keywords | self.ops:
            self.code[t] = self.voc.token(t)
        self.enders = frozenset(self.voc.token(t) for t in sets.get("Ender", []))
        self.starters = frozenset(self.voc.token(t) for t in sets.get("Starter", []))
        lit = {t: re.escape(self.voc.token(t)) for t in "()[]{}"}
        none = f"([^{''.join(lit.values())}]*)"
        self._innermost = re.compile("|".join(lit[o] + none + lit[c] for o, c in _OPEN.items()))
        self._bracket = re.compile(f"[{''.join(lit.values())}]")
        follow = "[" + "".join(map(re.escape, self.enders)) + "\U00010000-\U0010ffff]"
        self._no_end = re.compile(f"(?<!{follow})N|N(?![{''.join(map(re.escape, self.starters)) or 'N'}])") if self.enders else None
        self._after_end = re.compile(f"(?<={follow})N+") if self.enders else None

    def kind(self, t: str) -> str:
        """The character of a token that isn't a keyword or operator; '' for what doesn't count."""
        c = t[0]
        if c.isalpha() or c in "_$" or ord(c) > 127 and c.isidentifier():
            return "i"
        if c.isdigit() or c == "." and len(t) > 1:
            return "n"
        return self.special(t)

    def special(self, t: str) -> str:
        return ERROR

    def codes(self, tokens: list[str]) -> list[str]:
        code, kind = self.code, self.kind
        out = list(map(code.get, tokens))
        for k in [k for k, c in enumerate(out) if c is None]:
            t = tokens[k]
            out[k] = c = kind(t)
            if len(t) < 40:
                if len(code) > 200_000:
                    self.forget()
                code[t] = c
        return out

    def forget(self) -> None:
        self.code.clear()
        for t in self.keywords | self.ops:
            self.code[t] = self.voc.token(t)

    def lex(self, text: str) -> list[str]:
        return self.rx.findall(text)

    def exact(self, text: str) -> list[str]:
        """The tokens, one for each code."""
        return self.lex(text)

    def folded(self, text: str) -> str | None:
        """The top level's string, or None if brackets don't match: innermost brackets become groups, again and again."""
        return self.collapse(self.joined(text))

    def joined(self, text: str) -> str:
        tokens = self.lex(text)
        return "".join(self.codes(tokens))

    def collapse(self, s: str) -> str | None:
        group, settle = self.grammar.group, self.settle

        def one(m: re.Match) -> str:
            k = m.lastindex
            return group("PKB"[k - 1], settle(m.group(k), "([{"[k - 1]))

        n = 1
        while n:
            s, n = self._innermost.subn(one, s)
        return None if self._bracket.search(s) else settle(s, "")

    def fold(self, tokens: list[str], where: list | None = None) -> str | None:
        """The same token by token. where: gets for each level its tokens' numbers; stopped: the bracket without a match."""
        codes = self.codes(tokens)
        group = self.grammar.group
        stack: list[tuple[str, list[str], list]] = []
        level: list[str] = []
        marks: list = []
        for k, (t, c) in enumerate(zip(tokens, codes)):
            if t in _OPEN:
                stack.append((t, level, marks))
                level, marks = [], []
            elif t in ")]}" and len(t) == 1:
                if not stack or _OPEN[stack[-1][0]] != t:
                    self.stopped = k
                    return None
                o, outer, outer_marks = stack.pop()
                raw = "".join(level)
                settled = self.settle(raw, o)
                level = outer
                level.append(group(_GROUP[o], settled))
                if where is not None:
                    outer_marks.append((k, self.align(raw, settled, marks)))
                marks = outer_marks
            elif c:
                level.append(c)
                if where is not None:
                    marks.append((k, None))
        if stack:
            self.stopped = len(tokens)
            return None
        raw = "".join(level)
        settled = self.settle(raw, "")
        if where is not None:
            where.extend(self.align(raw, settled, marks))
        return settled

    @staticmethod
    def align(raw: str, settled: str, marks: list) -> list:
        """The marks of the characters that settling kept."""
        if raw == settled:
            return marks
        out, at = [], 0
        for c in settled:
            while raw[at] != c and not (raw[at] == "N" and ord(c) < 0x10000 and raw[at] not in settled):
                at += 1
            out.append(marks[at])
            at += 1
        return out

    def failure(self, text: str) -> int | None:
        """The number, from 0, of the token at which parsing got stuck; None if the source is valid."""
        self.grammar.fresh()
        tokens = self.exact(text)
        where: list = []
        top = self.fold(tokens, where)
        if top is None:
            return self.stopped
        rule, level, marks = self.start, top, where
        ok, far = self.grammar.parse(rule, level)
        if ok:
            return None
        while True:
            if far >= len(level):
                return marks[-1][0] + 1 if marks else 0
            k, inner = marks[far]
            tried = [(f, r) for (r, c), f in self.grammar.far.items() if c == level[far]] if inner is not None else []
            if not tried:
                return k
            inside = self.grammar.inner[level[far]]
            if not inner:
                return k
            far = max(tried)[0]
            level, marks = inside, inner

    def settle(self, level: str, opener: str) -> str:
        return level

    def valid(self, text: str) -> bool:
        self.grammar.fresh()
        top = self.folded(text)
        if top is None:
            return False
        ok, _ = self.grammar.parse(self.start, top)
        return ok


class LineLanguage(Language):
    """A language in which a line end may end a statement: it stays a token only between tokens that can do that."""

    def special(self, t: str) -> str:
        if t[0] == "\n":
            return "N"
        if t.startswith(("//", "/*")):
            return ("N" if "\n" in t else "") if t.startswith("//") or len(t) > 3 and t.endswith("*/") else ERROR
        if t[0] in "\"'" and len(t) > 1:
            return "s"
        if t[0] == "`" and len(t) > 1:
            return "t"
        return ERROR

    def settle(self, level: str, opener: str) -> str:
        if "N" not in level:
            return level
        if opener in ("(", "["):
            return level.replace("N", "")
        if "NN" in level:
            level = _RUN.sub("N", level)
        return self._no_end.sub("", level)

    def ends(self, c: str) -> bool:
        return c in self.enders or ord(c) >= 0x10000

    def starts(self, c: str) -> bool:
        return c in self.starters


# JavaScript and TypeScript ----------------------------------------------------------------------------------------------

_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}]*\}|`[^`]*`)*\})*`"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-zA-Z]*"
_JS_TOKENS = (
    r"\n|//[^\n]*|/\*[\s\S]*?\*/|/\*|" + _DQ + "|" + _SQ + "|" + _TEMPLATE
    + r"|(?:[=!]==?|&&|\|\||\?\?|[=(,:\[!&|?{};+\-*%~^<>]|=>|\b(?:return|typeof|case|in|of|void|delete|throw|new|else|do)\b)[ \t\r\n]*" + _REGEX
    + r"|#?" + _IDENT.replace(r"[^\W\d]\w*", r"(?:[^\W\d]|\$)[\w$]*") + "|" + _NUM + r"n?"
    + r"|\.\.\.|\?\.(?!\d)|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|=>|\*\*|<<|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\S"
)
_JS_KEYWORDS = "var const function class if else for while do try catch finally switch case default return throw break continue debugger new delete typeof void in instanceof this super null true false import export extends await yield let static async of get set from as enum with"
_JS_OPS = "; , . ? : = => == != === !== < > <= + - * / % ** & | ^ ! ~ && || ?? ++ -- += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= << ... ?. @ ( ) [ ] { } #"
_TS_EXTRA = "type interface namespace module declare abstract readonly public private protected override keyof infer is asserts satisfies unique out accessor"
_JS_CONTEXT = "let static async of get set from as await yield"
_ENDER = "ident num str regex template this super null true false ++ -- return break continue debugger yield".split()
_STARTER = "ident num str regex var const function class if for while do try switch return throw break continue debugger new delete typeof void this super null true false import export await yield let static async get set of from as enum @ ! ~ ++ -- case default # with * else".split()

_JS_GRAMMAR = r"""
Program <- StmtList
StmtList <- Stmt*
Stmt := ';' / 'nl' / B{StmtList} / Decl / Control / Label / 'import' !('.') !(P{Args}) ImportRest End / 'export' ExportRest / Expr End
End <- ';' / 'nl' / $
Label <- @I ':' Stmt
Decl <- ('var' / 'const' !('enum') / 'let' &(@I / K{ArrPat} / B{ObjPat})) VarDecls End / Func / Class / TsDecl
VarDecls <- VarDecl (',' VarDecl)*
VarDecl <- Target Definite? TypeAnn? ('=' Assign)?
Func <- 'async'? 'function' '*'? @I TypeParams? P{Params} RetType? (B{StmtList} / FuncEnd)
FuncEnd <- TsOnly End
Class <- Decorators 'abstract'? 'class' @I TypeParams? Heritage B{ClassBody}
Heritage <- ('extends' Postfix TypeArgs?)? Implements?
Decorators <- ('@' Postfix 'nl'?)*
ClassBody <- ('nl' / ';' / Member)*
Member := Decorators Modifiers (StaticBlock / Accessor / Method / Field / IndexSig End)
StaticBlock <- 'static' B{StmtList}
Accessor <- ('get' / 'set') PropName P{Params} RetType? MethodBody
Method <- 'async'? '*'? PropName Optional? TypeParams? P{Params} RetType? MethodBody
MethodBody <- B{StmtList} / TsOnly End
Field <- PropName Optional? TypeAnn? ('=' Assign)? End
PropName <- @Name / 'str' / 'num' / K{Expr} / '#' @Name
Control <- 'if' P{Expr} 'nl'? Stmt ('nl'? 'else' 'nl'? Stmt)?
  / 'for' 'await'? P{ForHead} 'nl'? Stmt
  / 'while' P{Expr} 'nl'? Stmt
  / 'do' 'nl'? Stmt 'nl'? 'while' P{Expr} End?
  / 'try' B{StmtList} ('catch' (P{CatchArg})? B{StmtList})? 'finally' B{StmtList}
  / 'try' B{StmtList} 'catch' (P{CatchArg})? B{StmtList}
  / 'switch' P{Expr} B{Cases}
  / 'with' P{Expr} 'nl'? Stmt
  / 'return' Expr? End
  / 'throw' Expr End
  / ('break' / 'continue') @I? End
  / 'debugger' End
CatchArg <- Target TypeAnn?
ForHead <- ('var' / 'const' / 'let') Target TypeAnn? ('of' Assign / 'in' Expr)
  / LeftHand ('of' Assign / 'in' Expr)
  / (('var' / 'const' / 'let') VarDecls / Expr)? ';' Expr? ';' Expr?
LeftHand <- Postfix
Cases <- ('nl' / ';')* ('case' Expr ':' CaseBody / 'default' ':' CaseBody)*
CaseBody <- (!('case' / 'default' ':') Stmt)*
Target <- @I / K{ArrPat} / B{ObjPat}
ArrPat <- (ArrPatItem? ',')* ArrPatItem?
ArrPatItem <- '...'? Target ('=' Assign)?
ObjPat <- (ObjPatItem (',' ObjPatItem)* ','?)?
ObjPatItem <- '...' @I / PropName ':' Target ('=' Assign)? / @I ('=' Assign)?
Params <- (Param (',' Param)* ','?)?
Param <- Decorators ParamModifiers '...'? (Target / TsThis) Optional? TypeAnn? ('=' Assign)?
Expr := Assign (',' Assign)*
Assign := Arrow / 'yield' '*'? Assign? / Cond (@AssignOp Assign)?
Arrow <- 'async'? (@I / TypeParams? P{Params} RetType?) '=>' (B{StmtList} / Assign)
Cond <- Binary ('?' (Assign ':' Assign / Cond (@AssignOp Assign)? ':' Assign))?
Binary <- Unary ((BinOp Unary) / AsType)*
BinOp <- @Bin / '>' '>'? '>'? '='? / '<' / 'in' / 'instanceof' / '<=' / '=='
Unary <- (@Un / 'await')* Postfix
Postfix <- Primary (@Access Tail / K{Expr} / P{Args} / 'template' / NonNull / TypeArgs &(CallParen) / TypeArgs 'template')* ('++' / '--')?
CallParen <- P{Args}
Tail <- '#'? @Name / P{Args} / K{Expr} / 'template'
Args <- ('...'? Assign (',' '...'? Assign)* ','?)?
Primary <- 'function' '*'? @I? TypeParams? P{Params} RetType? B{StmtList}
  / 'async' 'function' '*'? @I? TypeParams? P{Params} RetType? B{StmtList}
  / 'class' @I? TypeParams? Heritage B{ClassBody}
  / 'new' '.' @I / 'new' Postfix / 'import' P{Args} / 'import' '.' @I
  / @I / @Literal / '#' @I / P{Expr} / K{ArrLit} / B{ObjLit} / Decorators1 'class' @I? Heritage B{ClassBody} / TypeCast
Decorators1 <- ('@' Postfix)*
ArrLit := (('...'? Assign)? ',')* ('...'? Assign)?
ObjLit <- (Prop (',' Prop)* ','?)?
Prop := '...' Assign / ('get' / 'set') PropName P{Params} RetType? B{StmtList} / 'async'? '*'? PropName TypeParams? P{Params} RetType? B{StmtList} / PropName ':' Assign / @I ('=' Assign)?
ImportRest <- 'str' ImportWith End0 / TypeWord? ImportClause 'from' 'str' ImportWith / TsImport
ImportWith <- ('with' B{ObjLit})?
End0 <- &(End)
ImportClause <- @I ',' ('*' 'as' @I / B{ImportNames}) / '*' 'as' @I / B{ImportNames} / @I
ImportNames <- (ImportName (',' ImportName)* ','?)?
ImportName <- TypeWord? (@Name / 'str') ('as' @Name)?
ExportRest <- 'default' (Func / AnonFunc / Class / AnonClass / TsDecl / Assign End) / '*' ('as' (@Name / 'str'))? 'from' 'str' End / TypeWord? B{ImportNames} ('from' 'str')? End / Decl / TsExport
AnonFunc <- 'async'? 'function' '*'? TypeParams? P{Params} RetType? B{StmtList}
AnonClass <- Decorators 'abstract'? 'class' TypeParams? Heritage B{ClassBody}
Never <- !(.) .
"""
_JS_ONLY = r"""
TypeAnn <- Never
RetType <- Never
TypeParams <- Never
TypeArgs <- Never
Implements <- Never
Optional <- Never
Definite <- Never
Modifiers <- ('static' &(PropName / 'async' / '*' / 'get' / 'set'))?
ParamModifiers <- ('ident' &(Never))?
TsOnly <- Never
TsDecl <- Never
TsThis <- Never
TsImport <- Never
TsExport <- Never
IndexSig <- Never
AsType <- Never
NonNull <- Never
TypeWord <- Never
TypeCast <- Never
"""
_TS_ONLY = r"""
TypeAnn <- ':' Type
RetType <- ':' ('asserts' @I ('is' Type)? / (@I / 'this') 'is' Type / Type)
TypeParams <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / 'out')* @I ('extends' Type)? ('=' Type)?
TypeArgs <- '<' Type (',' Type)* ','? '>'
Implements <- 'implements' Type (',' Type)*
Optional <- '?' / '!'
Definite <- '!'
Modifiers <- (('public' / 'private' / 'protected' / 'static' / 'abstract' / 'readonly' / 'override' / 'declare' / 'accessor') !('=' / ';' / ':' / '?' / '!' / 'nl' / P{Params} / B{StmtList} / $))*
ParamModifiers <- (('public' / 'private' / 'protected' / 'readonly' / 'override') &(@I / B{ObjPat} / K{ArrPat}))*
TsOnly <- &(.)? &(End)
TsThis <- 'this'
TsDecl <- 'interface' @I TypeParams? ('extends' Type (',' Type)*)? B{TypeBody}
  / 'type' @I TypeParams? '=' Type End
  / 'const'? 'enum' @I B{EnumBody}
  / 'declare' (Decl / 'function' @I TypeParams? P{Params} RetType? End / ('module' / 'namespace') ('str' / Qualified) B{StmtList} / 'global' B{StmtList})
  / ('namespace' / 'module') (Qualified / 'str') B{StmtList}
Qualified <- @I ('.' @Name)*
EnumBody <- (EnumItem (',' EnumItem)* ','?)?
EnumItem <- (@Name / 'str') ('=' Assign)?
TsImport <- @I '=' ('require' P{Args} / Qualified)
TsExport <- '=' Expr End / 'as' 'namespace' @I End / 'import' TsImport End
IndexSig <- K{IndexKey} TypeAnn
IndexKey <- @I ':' Type
AsType <- ('as' / 'satisfies') ('const' / Type)
NonNull <- '!'
TypeWord <- 'type' !('from' / ',' / 'as' 'as')
TypeCast <- '<' Type '>' Unary
Type := ('|' / '&')? TypeUnion ('extends' TypeUnion '?' Type ':' Type)?
TypeUnion <- TypeTerm (('|' / '&') TypeTerm)*
TypeTerm <- ('abstract'? 'new')? TypeParams? P{Params} '=>' RetTypeBody / ('keyof' / 'readonly' / 'unique' / 'infer')* TypePrim (K{TypeIndex})*
RetTypeBody <- 'asserts' @I ('is' Type)? / (@I / 'this') 'is' Type / Type
TypeIndex <- Type?
TypePrim <- 'typeof' ('import' P{Args} / Qualified) TypeArgs? / 'import' P{Args} ('.' @Name)* TypeArgs? / Qualified TypeArgs? / 'this' / 'null' / 'void' / 'true' / 'false' / 'str' / 'num' / 'template' / '-' 'num' / P{Type} / B{MappedType} / B{TypeBody} / K{TupleBody}
TupleBody <- (TupleItem (',' TupleItem)* ','?)?
TupleItem <- '...'? (@I '?'? ':' Type / Type '?'?)
MappedType <- (('+' / '-')? 'readonly')? K{MappedKey} (('+' / '-')? '?')? TypeAnn? (';' / 'nl' / ',')?
MappedKey <- @I 'in' Type ('as' Type)?
TypeBody <- ('nl' / ';' / ',' / TypeMember (&($) / ';' / ',' / 'nl'))*
TypeMember := ('readonly' &(PropName / K{IndexKey}))? (IndexSig / ('get' / 'set') PropName P{Params} RetType? / 'new'? TypeParams? P{Params} RetType? / PropName '?'? TypeParams? P{Params} RetType? / PropName '?'? TypeAnn?)
"""


_BEFORE_REGEX = re.compile(r"([a-z]+|[^\w\s/]+)[ \t\r\n]*(?=/)")


class Script(LineLanguage):
    def special(self, t: str) -> str:
        if t[0] == "#" and len(t) > 1:
            return "i" if t[1] != "!" else ""
        if t[0] == "`" and len(t) > 1:
            return "t" if "${" not in t or all(self.inner_valid(e) for e in re.findall(r"\$\{((?:[^{}`]|\{[^{}]*\}|`[^`]*`)*)\}", t)) else ERROR
        return super().special(t)

    @lru_cache(maxsize=20_000)  # noqa: B019
    def inner_valid(self, e: str) -> bool:
        top = self.folded(e)
        return top is not None and self.grammar.parse("Expr", top)[0]

    def lex(self, text: str) -> list[str]:
        if text.startswith("﻿"):
            text = text[1:]
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        return self.rx.findall(text)

    def exact(self, text: str) -> list[str]:
        out = []
        for t in self.lex(text):
            m = _BEFORE_REGEX.match(t) if len(t) > 2 and t[0] not in "/\"'`\n#" and "/" in t else None
            out += [m.group(1), "/re/"] if m else [t]
        return out

    def kind(self, t: str) -> str:
        if t == "/re/":
            return "x"
        # A regular expression literal is lexed together with what must stand before it.
        m = _BEFORE_REGEX.match(t) if len(t) > 2 and t[0] not in "/\"'`\n#" and "/" in t else None
        return self.code[m.group(1)] + "x" if m else super().kind(t)



def _script(ts: bool) -> Script:
    words = _JS_KEYWORDS + (" " + _TS_EXTRA + " implements require global" if ts else "")
    context = (_JS_CONTEXT + (" " + _TS_EXTRA + " require global" if ts else "")).split()
    all_words = words.split()
    sets = {
        "I": ["ident", *context],
        "Name": ["ident", *all_words],
        "Literal": "num str regex template this super null true false".split(),
        "AssignOp": "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split(),
        "Bin": "+ - * / % ** & | ^ && || ?? == != === !== <= << <".split(),
        "Un": "! ~ + - ++ -- typeof void delete".split(),
        "Access": ". ?.".split(),
        "Ender": [*_ENDER, *[w for w in context if w not in ("async",)], *([">", "void", "const"] if ts else [])],
        "Starter": [*_STARTER, *(["public", "private", "protected", "readonly", "abstract", "declare", "type", "interface", "namespace", "module", "override", "keyof", "is", "require", "global"] if ts else [])],
    }
    grammar = _JS_GRAMMAR + (_TS_ONLY if ts else _JS_ONLY)
    return Script("typescript" if ts else "javascript", _JS_TOKENS, words, _JS_OPS, grammar, "Program", sets)


# Go -----------------------------------------------------------------------------------------------------------------------

_GO_TOKENS = r"\n|//[^\n]*|/\*[\s\S]*?\*/|/\*|" + _DQ + r"|'(?:[^'\\\n]|\\[^\n])+'|`[^`]*`|" + _IDENT + "|" + _NUM + r"i?|\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|\S"
_GO_KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO_OPS = "; , . : = == != < > <= >= + - * / % & | ^ &^ ! && || <- ++ -- := += -= *= /= %= &= |= ^= <<= >>= &^= << >> ... ~ ( ) [ ] { }"
_GO_GRAMMAR = r"""
Source <- ';'* 'package' 'ident' Semi ImportDecl* TopDecl*
Semi <- ';'+ / $
ImportDecl <- 'import' (ImportSpec / P{ImportSpecs}) Semi
ImportSpecs <- (ImportSpec (';'+ / $))*
ImportSpec <- ('ident' / '.')? ('str' / 'template')
TopDecl := (FuncDecl / Decl) Semi
Decl <- 'var' (VarSpec / P{VarSpecs}) / 'const' (ConstSpec / P{ConstSpecs}) / 'type' (TypeSpec / P{TypeSpecs})
VarSpecs <- (VarSpec (';'+ / $))*
VarSpec <- Idents (Type ('=' Exprs)? / '=' Exprs)
ConstSpecs <- (ConstSpec (';'+ / $))*
ConstSpec <- Idents (Type? '=' Exprs)?
TypeSpecs <- (TypeSpec (';'+ / $))*
TypeSpec <- 'ident' (K{TypeParams} !($ / ';'))? '='? Type
TypeParams <- TypeParam (',' TypeParam)* ','?
TypeParam <- Idents Constraint
Constraint <- ('~'? Type) ('|' '~'? Type)*
Idents <- 'ident' (',' 'ident')*
FuncDecl <- 'func' (P{Params})? 'ident' (K{TypeParams})? Signature B{Stmts}? 
Signature <- P{Params} Result?
Result <- P{Params} / Type
Params <- (Param (',' Param)* ','?)?
Param <- Idents '...'? Type / '...'? Type
Type := 'ident' ('.' 'ident')? (K{TypeList})? / '*' Type / K{ArrayLen} Type / 'map' K{Type} Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' Signature / 'struct' B{Fields} / 'interface' B{Methods} / P{Type}
TypeList <- Type (',' Type)* ','?
ArrayLen <- ('...' / Expr)?
Fields <- (Field (';'+ / $))*
Field <- (Idents Type / '*'? 'ident' ('.' 'ident')? (K{TypeList})?) ('str' / 'template')?
Methods <- ((Method / Constraint) (';'+ / $))*
Method <- 'ident' Signature
Stmts <- ';'* (Stmt (';'+ / $))* 
Stmt := Decl / 'ident' ':' Stmt? / If / For / Switch / 'select' B{Comms} / 'return' Exprs? / ('break' / 'continue' / 'goto') 'ident'? / 'fallthrough' / ('go' / 'defer') Expr / B{Stmts} / Simple
Simple <- Exprs (':=' / @AssignOp) Exprs / Expr '<-' Expr / Expr ('++' / '--') / Expr
If <- 'if' Header B{Stmts} ('else' (If / B{Stmts}))?
Header <- (HSimple? ';')? HSimple
HSimple <- HExprs (':=' / @AssignOp) HExprs / HExpr '<-' HExpr / HExpr ('++' / '--') / HExpr
For <- 'for' (RangeHead / HSimple? ';' HExpr? ';' HSimple? / HExpr)? B{Stmts}
RangeHead <- (HExprs (':=' / '='))? 'range' HExpr
Switch <- 'switch' (HSimple? ';')? (TypeSwitch / HExpr)? B{Cases}
TypeSwitch <- ('ident' ':=')? HPrimary
Cases <- ';'* (('case' CaseList / 'default') ':' CaseBody)*
CaseList <- Exprs &(':') / CaseType (',' CaseType)*
CaseType <- Type &(',' / ':') / Expr
CaseBody <- (';' / !('case' / 'default') Stmt (';'+ / $))*
Comms <- ';'* (('case' Comm / 'default') ':' CaseBody)*
Comm <- Exprs (':=' / '=') Expr / Expr '<-' Expr / Expr
Exprs <- Expr (',' Expr)*
HExprs <- HExpr (',' HExpr)*
Expr := Unary (@Bin Unary)*
HExpr := HUnary (@Bin HUnary)*
Unary <- @Un* Primary
HUnary <- @Un* HPrimary
Primary <- Operand (B{Literal})? Tail*
Tail <- '.' 'ident' / '.' P{TypeOrWord} / K{Index} / P{Args} / LiteralAfterIndex
LiteralAfterIndex <- B{Literal}
HPrimary <- HOperand HTail*
HTail <- '.' 'ident' / '.' P{TypeOrWord} / K{Index} / P{Args}
TypeOrWord <- 'type' / Type
Operand <- 'func' Signature B{Stmts} / CompType / 'num' / 'str' / 'template' / 'ident' / P{Expr} / P{Type} / Type
CompType <- (K{ArrayLen} Type / 'map' K{Type} Type / 'struct' B{Fields}) &(B{Literal} / P{Args})
HOperand <- 'func' Signature B{Stmts} / (K{ArrayLen} Type / 'map' K{Type} Type / 'struct' B{Fields}) (B{Literal} / &(P{Args})) / 'num' / 'str' / 'template' / 'ident' / P{Expr} / P{Type} / K{ArrayLen} Type / 'chan' Type
Index <- Expr? (':' Expr?)? (':' Expr?)? $ / TypeList
Args <- (Arg (',' Arg)* '...'? ','?)?
Arg <- Expr / Type
Literal := (Element (',' Element)* ','?)?
Element <- (Expr / B{Literal}) (':' (Expr / B{Literal}))?
"""


class Go(LineLanguage):
    def special(self, t: str) -> str:
        if t[0] == "'" and len(t) > 1:
            return "n"
        return super().special(t)

    def settle(self, level: str, opener: str) -> str:
        """Go's rule: a line end after a token that can end a statement is a semicolon."""
        if "N" not in level:
            return level
        return self._after_end.sub(self.voc.token(";"), level).replace("N", "")


def _go() -> Go:
    sets = {
        "AssignOp": "= += -= *= /= %= &= |= ^= <<= >>= &^=".split(),
        "Bin": "|| && == != < <= > >= + - | ^ * / % << >> & &^".split(),
        "Un": "+ - ! ^ * & <- ~".split(),
        "Ender": "ident num str template break continue fallthrough return ++ --".split(),
    }
    return Go("go", _GO_TOKENS, _GO_KEYWORDS, _GO_OPS, _GO_GRAMMAR, "Source", sets)


# Java ---------------------------------------------------------------------------------------------------------------------

_JAVA_TOKENS = r'//[^\n]*|/\*[\s\S]*?\*/|/\*|"""[ \t]*\r?\n(?:[^"\\]|\\[\s\S]|"(?!""))*"""|' + _DQ + r"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|[^\n]))'|(?:[^\W\d]|\$)[\w$]*|" + _NUM + r"[lLfFdD]?|\.\.\.|->|::|<<=|<=|==|!=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\S"
_JAVA_KEYWORDS = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null record sealed non permits yield var when module"
_JAVA_OPS = "; , . : = == != < > <= + - * / % & | ^ ! ~ && || ++ -- += -= *= /= %= &= |= ^= <<= << -> :: ? ... @ ( ) [ ] { }"
_JAVA_GRAMMAR = r"""
Unit <- ';'* (Annots 'package' Name ';')? (Import / ';')* (TypeDecl / ';')* (Method1 / Field1)*
Method1 <- Never
Field1 <- Never
Never <- !(.) .
Import <- 'import' 'static'? Name ('.' '*')? ';'
Name <- @I ('.' @I)*
Annots <- Annot*
Annot <- '@' !('interface') Name (P{AnnotArgs})?
AnnotArgs <- (AnnotArg (',' AnnotArg)* ','?)?
AnnotArg <- @I '=' AnnotValue / AnnotValue
AnnotValue <- Annot / B{AnnotValues} / Cond
AnnotValues <- (AnnotValue (',' AnnotValue)* ','?)?
Mods <- (Annot / @Mod / 'non' '-' 'sealed' / 'sealed' &(Mods1) / 'default' !(':' / '->'))*
Mods1 <- (Annot / @Mod)* ('class' / 'interface' / 'abstract')
TypeDecl := Mods (ClassDecl / EnumDecl / InterfaceDecl / RecordDecl / AnnotDecl)
ClassDecl <- 'class' @I TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? B{ClassBody}
RecordDecl <- 'record' @I TypeParams? P{Params} ('implements' Types)? B{ClassBody}
InterfaceDecl <- 'interface' @I TypeParams? ('extends' Types)? ('permits' Types)? B{ClassBody}
AnnotDecl <- '@' 'interface' @I B{ClassBody}
EnumDecl <- 'enum' @I ('implements' Types)? B{EnumBody}
EnumBody <- (EnumConst (',' EnumConst)* ','?)? (';' ClassBody)?
EnumConst <- Annots @I (P{Args})? (B{ClassBody})?
ClassBody <- Member*
Member := ';' / TypeDecl / 'static'? B{Stmts} / Mods TypeParams? (Method / Ctor / FieldDecl)
Ctor <- @I (P{Params})? ('throws' Types)? B{Stmts}
Method <- Type @I P{Params} Dims ('throws' Types)? ('default' AnnotValue)? (B{Stmts} / ';')
FieldDecl <- Type Vars ';'
Vars <- Var (',' Var)*
Var <- @I Dims ('=' (B{ArrayInit} / Expr))?
ArrayInit := ((B{ArrayInit} / Expr) (',' (B{ArrayInit} / Expr))* ','?)?
Dims <- (Annots K{Nothing})*
Nothing <- $
Params <- (Param (',' Param)*)?
Param <- (Annot / 'final')* Type Annots '...'? (@I '.')* (@I / 'this') Dims
TypeParams <- '<' TypeParam (',' TypeParam)* '>'
TypeParam <- Annots @I ('extends' Type ('&' Type)*)?
Types <- Type (',' Type)*
Type := Annots (@Prim / @I TypeArgs? ('.' Annots @I TypeArgs?)*) Dims / 'void' !(@I '=')
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- Annots '?' (('extends' / 'super') Type)? / Type
Stmts <- Stmt*
Stmt := ';' / B{Stmts} / Control / LocalType / LocalVar ';' / @I ':' Stmt / Expr ';'
LocalType <- &(Mods ('class' / 'interface' / 'enum' / 'record' @I (TypeParams / P{Params}) )) TypeDecl
LocalVar <- (Annot / 'final')* Type Vars
Control <- 'if' P{Expr} Stmt ('else' Stmt)?
  / 'for' P{ForHead} Stmt
  / 'while' P{Expr} Stmt
  / 'do' Stmt 'while' P{Expr} ';'
  / 'try' (P{Resources})? B{Stmts} Catch* ('finally' B{Stmts}) / 'try' (P{Resources})? B{Stmts} Catch+ / 'try' P{Resources} B{Stmts}
  / 'switch' P{Expr} B{SwitchBody}
  / 'synchronized' P{Expr} B{Stmts}
  / 'return' Expr? ';'
  / 'throw' Expr ';'
  / ('break' / 'continue') @I? ';'
  / 'yield' !('=' / '.' / '++' / '--' / P{Args}) Expr ';'
  / 'assert' Expr (':' Expr)? ';'
Catch <- 'catch' P{CatchArg} B{Stmts}
CatchArg <- (Annot / 'final')* Type ('|' Type)* @I
Resources <- Resource (';' Resource)* ';'?
Resource <- (Annot / 'final')* Type @I '=' Expr / Postfix
ForHead <- (Annot / 'final')* Type @I ':' Expr / (LocalVar / Expr (',' Expr)*)? ';' Expr? ';' (Expr (',' Expr)*)?
SwitchBody <- (SwitchLabel (':' (!('case' / 'default' (':' / '->')) Stmt)* / '->' (B{Stmts} / 'throw' Expr ';' / Expr ';')))*
SwitchLabel <- 'case' CaseItem (',' CaseItem)* ('when' Expr)? / 'default'
CaseItem <- 'default' / Pattern / Cond
Pattern <- (Annot / 'final')* Type (P{Patterns} (!('when') @I)? / !('when') @I)
Patterns <- (Pattern (',' Pattern)*)?
Expr := Lambda / Cond (@AssignOp Expr / '>' '>' '>'? '=' Expr / '>' '>=' Expr)?
Lambda <- (@I / P{LambdaParams}) '->' (B{Stmts} / Expr)
LambdaParams <- (@I (',' @I)* / Param (',' Param)*)?
Cond <- Binary ('?' Expr ':' (Lambda / Cond))?
Binary <- Unary ((BinOp Unary) / 'instanceof' (Pattern / 'final'? Type))*
BinOp <- @Bin / '>' '>' '>' !('=') / '>' '>' !('=') / '>' '='? / '<'
Unary <- @Un Unary / Cast / Postfix
Cast <- P{CastPrim} Unary / P{CastType} &(CastNext) (Lambda / Unary)
CastPrim <- @Prim Dims
CastType <- Type ('&' Type)*
CastNext <- !(@NoCast) .
Postfix <- Primary Suffix* ('++' / '--')*
Suffix <- '.' 'new' Annots @I TypeArgs? P{Args} (B{ClassBody})? / '.' TypeArgs? (@I / 'super' / 'this' / 'class') / K{Expr} / P{Args} / '::' TypeArgs? (@I / 'new')
Primary <- 'new' Creator / 'switch' P{Expr} B{SwitchBody} / MethodRefType / @Prim Dims '.' 'class' / 'void' '.' 'class' / @Literal / 'this' / 'super' / ArrayClass / @I / P{Expr}
MethodRefType <- Type '::' ('new' / @I)
ArrayClass <- Name (K{Nothing})+ '.' 'class'
Creator <- Annots (@Prim / Name TypeArgs? ('.' @I TypeArgs?)*) (K{Expr})+ (K{Nothing})* / Annots (@Prim / Name TypeArgs?) (K{Nothing})+ B{ArrayInit} / TypeArgs? Annots Name TypeArgs? ('.' @I TypeArgs?)* P{Args} (B{ClassBody})?
Args <- (Expr (',' Expr)*)?
"""


class Java(Language):
    def special(self, t: str) -> str:
        if t.startswith("//"):
            return ""
        if t.startswith("/*"):
            return "" if len(t) > 3 and t.endswith("*/") else ERROR
        if t[0] == '"' and len(t) > 1:
            return "s"
        if t[0] == "'" and len(t) > 1:
            return "n"
        return ERROR


def _java() -> Java:
    context = "record sealed non permits yield var when module".split()
    prim = "boolean byte char short int long float double".split()
    sets = {
        "I": ["ident", *context],
        "Prim": prim,
        "Mod": "public protected private static abstract final native synchronized transient volatile strictfp".split(),
        "Literal": "num str true false null".split(),
        "AssignOp": "= += -= *= /= %= &= |= ^= <<=".split(),
        "Bin": "|| && | ^ & == != <= << + - * / %".split(),
        "Un": "+ - ++ -- ! ~".split(),
        "NoCast": "+ - * / % = == != < > <= & | ^ && || ? : ; , . ++ -- += -= *= /= %= &= |= ^= << <<= instanceof -> :: ...".split(),
    }
    return Java("java", _JAVA_TOKENS, _JAVA_KEYWORDS, _JAVA_OPS, _JAVA_GRAMMAR, "Unit", sets)


# Python -------------------------------------------------------------------------------------------------------------------

_PY_PREFIX = r"(?:[rRbBuUfFtT]|[rR][bBfFtT]|[bBfFtT][rR])?"
#: A formatted string on one line, whose replacement fields may hold quotes of its own kind.
_PY_FIELD = r"\{(?:[^{}\n\"']|\"[^\"\n]*\"|'[^'\n]*'|\{[^{}\n]*\})*\}"
_PY_FORMAT = "|".join(r"(?:[fFtT][rR]?|[rR][fFtT])" + q + r"(?!" + q + q + r")(?:[^\\\n{" + q + r"]|\\[\s\S]|\{\{|" + _PY_FIELD + ")*" + q for q in ('"', "'")) + "|"
_PY_TOKENS = (
    r"(?:\r?\n[ \t\f]*(?:#[^\n]*)?)+|\\\r?\n|#[^\n]*|" + _PY_FORMAT + _PY_PREFIX + r"\"\"\"(?:[^\\\"]|\\[\s\S]|\"(?!\"\"))*\"\"\"|" + _PY_PREFIX + r"'''(?:[^\\']|\\[\s\S]|'(?!''))*'''|"
    + _PY_PREFIX + r"\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|" + _PY_PREFIX + r"\"\"(?!\")|" + _PY_PREFIX + r"'(?!'')(?:[^'\\\n]|\\[\s\S])*'|" + _PY_PREFIX + r"''(?!')|"
    + r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+\-]?\d(?:_?\d)*)?[jJ]?)(?![\w.])|"
    + r"(?:0[xX][\da-fA-F_]+|\d[\d_]*\.?\d*)(?=\.[^\W\d]|(?:and|or|if|in|is|else|for|not)\b)|" + _IDENT
    + r"|\.\.\.|\*\*=|//=|>>=|<<=|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|[^\s]"
)
_PY_KEYWORDS = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type"
_PY_OPS = "; , . : = -> := == != < > <= >= + - * / // % ** @ & | ^ ~ << >> += -= *= /= //= %= **= @= &= |= ^= <<= >>= ... ( ) [ ] { } !"
_PY_GRAMMAR = r"""
Module <- ('nl' / Stmt)*
Stmts <- ('nl' / Stmt)+
Stmt := Compound / Simples
Simples <- Simple (';' Simple)* ';'? 'nl'
Simple <- Assign / Yield / 'pass' / 'break' / 'continue' / 'return' StarExprs? / 'raise' (Expr ('from' Expr)?)? / ('global' / 'nonlocal') @I (',' @I)* / 'del' DelTargets / 'assert' Expr (',' Expr)? / Import / 'type' @I (K{TypeParams})? '=' Expr / StarExprs
Assign <- Single ':' Expr ('=' AnnRhs)? / (Targets '=' !('='))+ AnnRhs / Single @AugOp AnnRhs
AnnRhs <- Yield / StarExprs
Yield <- 'yield' 'from' Expr / 'yield' StarExprs?
Import <- 'import' DottedAs (',' DottedAs)* / 'from' ('.' / '...')* Dotted 'import' ImportNames / 'from' ('.' / '...')+ 'import' ImportNames
DottedAs <- Dotted ('as' @I)?
Dotted <- @I ('.' @I)*
ImportNames <- '*' / P{ImportList} / ImportAs (',' ImportAs)*
ImportList <- ImportAs (',' ImportAs)* ','?
ImportAs <- @I ('as' @I)?
Block <- 'nl' D{Stmts} / Simples
Compound <- If / While / For / Try / With / Def / Class / 'async' (For / With / Def) / Match
If <- 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
While <- 'while' Named ':' Block ('else' ':' Block)?
For <- 'for' Targets 'in' StarExprs ':' Block ('else' ':' Block)?
Try <- 'try' ':' Block (('except' '*'? (Expr (',' Expr)* ('as' @I)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? / 'finally' ':' Block)
With <- 'with' (P{WithItems} / WithItem (',' WithItem)*) ':' Block / 'with' WithItem (',' WithItem)* ':' Block
WithItems <- WithItem (',' WithItem)* ','?
WithItem <- Expr ('as' Single1)?
Single1 <- Target / Star1
Star1 <- P{TargetList} / K{TargetList}
Decorators <- ('@' Named 'nl')*
Def <- Decorators 'async'? 'def' @I (K{TypeParams})? P{Params} ('->' Expr)? ':' Block
Class <- Decorators 'class' @I (K{TypeParams})? (P{Args})? ':' Block
TypeParams <- TypeParam (',' TypeParam)* ','?
TypeParam <- ('*' / '**')? @I (':' Expr)? ('=' Expr)?
Params <- (Param (',' Param)* ','?)?
Param <- '/' / '**' @I Ann? / '*' @I StarAnn? / '*' / @I Ann? ('=' Expr)?
Ann <- ':' Expr
StarAnn <- ':' '*'? Expr
Match <- 'match' Subject ':' 'nl' D{Cases}
Subject <- StarNamed (',' StarNamed)* ','?
Cases <- ('case' Patterns ('if' Named)? ':' Block)+
Patterns <- StarPattern (',' StarPattern)* ','? 
StarPattern <- '*' @I / AsPattern
AsPattern <- OrPattern ('as' @I)?
OrPattern <- ClosedPattern ('|' ClosedPattern)*
ClosedPattern <- '-'? 'num' (('+' / '-') 'num')? / 'str'+ / 'None' / 'True' / 'False' / Dotted (P{PatArgs})? / P{PatSeq} / K{PatSeq} / B{PatMap}
PatSeq <- (StarPattern (',' StarPattern)* ','?)?
PatArgs <- (PatArg (',' PatArg)* ','?)?
PatArg <- @I '=' AsPattern / AsPattern
PatMap <- (PatItem (',' PatItem)* ','?)?
PatItem <- '**' @I / ('-'? 'num' / 'str'+ / 'None' / 'True' / 'False' / Dotted) ':' AsPattern
Targets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*'? Target
TargetList <- (StarTarget (',' StarTarget)* ','?)?
Target <- Single / P{TargetList} !(@Trail) !(K{Slices}) !(P{Args}) / K{TargetList} !(@Trail) !(K{Slices}) !(P{Args})
Single <- Chain / @I !(@Trail) !(K{Slices}) !(P{Args}) / P{Single}
Chain <- Atom (Trailer &(Trailer))* ('.' @I / K{Slices})
DelTargets <- DelTarget (',' DelTarget)* ','?
DelTarget <- Single / P{DelList} / K{DelList}
DelList <- DelTargets?
StarExprs <- StarExpr (',' StarExpr)* ','?
StarExpr <- '*' BitOr / Expr
StarNamed <- '*' BitOr / Named
Named <- @I ':=' Expr / Expr !(':=')
Expr := Lambda / Or ('if' Or 'else' Expr)?
Lambda <- 'lambda' LambdaParams ':' Expr
LambdaParams <- (LambdaParam (',' LambdaParam)* ','?)?
LambdaParam <- '/' / ('*' / '**') @I / '*' / @I ('=' Expr)?
Or <- And ('or' And)*
And <- Not ('and' Not)*
Not <- 'not' Not / Compare
Compare <- BitOr ((@Comp / 'not' 'in' / 'in' / 'is' 'not' / 'is') BitOr)*
BitOr := Unary (@Bin Unary)*
Unary <- @Un* Power
Power <- 'await'? Atom Trailer* ('**' Unary)?
Trailer <- '.' @I / P{Args} / K{Slices}
Atom <- @I / 'None' / 'True' / 'False' / 'num' / 'str'+ / '...' / P{Group} / K{ListBody} / B{DictOrSet}
Group <- Yield / Named CompFor / (StarNamed (',' StarNamed)* ','?)?
ListBody := Named CompFor / (StarNamed (',' StarNamed)* ','?)?
DictOrSet := DictItem CompFor / (DictItem (',' DictItem)* ','?)? $ / Named CompFor / StarNamed (',' StarNamed)* ','?
DictItem <- '**' BitOr / Expr ':' Expr
CompFor <- ('async'? 'for' Targets 'in' Or ('if' CompIf)*)+
CompIf <- Or / Lambda
Args <- Named CompFor / (Arg (',' Arg)* ','?)?
Arg <- @I '=' !('=') Expr / '*' Expr / '**' Expr / Named
Slices <- Slice (',' Slice)* ','?
Slice <- Expr? ':' Expr? (':' Expr?)? / StarNamed
"""


_INDENT = 0xE000
_LINE_END = re.compile("[\ue000-\uefff]")


class Python(Language):
    def special(self, t: str) -> str:
        if t[0] in "\"'" and len(t) > 1:
            return "s"
        return ERROR

    def kind(self, t: str) -> str:
        c = t[0]
        if c in "\n\r":
            # A line end carries the next line's indentation.
            return chr(_INDENT + min(len(t[t.rfind("\n") + 1 :].expandtabs(8)), 0xFFF))
        if c == "#" or c == "\\" and len(t) > 1:
            return ""
        if t[-1] in "\"'" and len(t) > 1:
            return "s"
        return super().kind(t)

    def settle(self, level: str, opener: str) -> str:
        return _LINE_END.sub("", level) if opener else level

    def folded(self, text: str) -> str | None:
        s = self.collapse(self.joined(text))
        if s is None:
            return None
        group = self.grammar.group
        blocks: list[tuple[int, list[str]]] = []
        level: list[str] = []
        indent = 0
        parts = _LINE_END.split(s)
        widths = [0, *map(ord, _LINE_END.findall(s))]
        for line, width in zip(parts, widths):
            if not line:
                continue
            width = width and width - _INDENT
            if width > indent:
                blocks.append((indent, level))
                level, indent = [], width
            else:
                while width < indent:
                    indent, outer = blocks.pop()
                    outer.append(group("D", "".join(level)))
                    level = outer
                if width != indent:
                    return None
            level.append(line + "N")
        while blocks:
            indent, outer = blocks.pop()
            outer.append(group("D", "".join(level)))
            level = outer
        return "".join(level)

    def fold(self, tokens: list[str], where: list | None = None) -> str | None:
        """Brackets become groups, and so do indented blocks: 'nl' before, an indented group after."""
        group = self.grammar.group
        code = self.code
        stack: list[tuple[str, list[str], list]] = []  # open brackets within the line
        blocks: list[tuple[int, list[str], list]] = []
        indent = 0
        level: list[str] = []
        marks: list = []
        fresh = True  # at a line's beginning
        last = len(tokens) - 1
        while last >= 0 and (tokens[last][0] in "\r\n#" or tokens[last][0] == "\\"):
            last -= 1
        for k in range(last + 1):
            t = tokens[k]
            c0 = t[0]
            if c0 == "\n" or c0 == "\r":
                if stack:
                    continue
                if not fresh:
                    level.append("N")
                    marks.append((k, None))
                    fresh = True
                if k == 0 or fresh:
                    width = len(t[t.rfind("\n") + 1 :].expandtabs(8))
                    if k == 0 and not level:
                        if width:
                            self.stopped = k
                            return None
                        continue
                    if width > indent:
                        blocks.append((indent, level, marks))
                        level, marks, indent = [], [], width
                    else:
                        while width < indent:
                            indent, outer, outer_marks = blocks.pop()
                            outer.append(group("D", "".join(level)))
                            outer_marks.append((k, marks))
                            level, marks = outer, outer_marks
                        if width != indent:
                            self.stopped = k
                            return None
                continue
            if c0 == "#" or c0 == "\\" and len(t) > 1:
                continue
            if k == 0 and c0 in " \t":
                self.stopped = k
                return None
            fresh = False
            if t in _OPEN:
                stack.append((t, level, marks))
                level, marks = [], []
                continue
            if t in ")]}":
                if not stack or _OPEN[stack[-1][0]] != t:
                    self.stopped = k
                    return None
                o, outer, outer_marks = stack.pop()
                outer.append(group(_GROUP[o], "".join(level)))
                outer_marks.append((k, marks))
                level, marks = outer, outer_marks
                continue
            c = code.get(t)
            if c is None:
                c = self.kind(t)
                if len(t) < 40:
                    if len(code) > 200_000:
                        self.forget()
                    code[t] = c
            level.append(c)
            marks.append((k, None))
        if stack:
            self.stopped = len(tokens)
            return None
        if not fresh:
            level.append("N")
            marks.append((last + 1, None))
        while blocks:
            indent, outer, outer_marks = blocks.pop()
            outer.append(group("D", "".join(level)))
            outer_marks.append((last + 1, marks))
            level, marks = outer, outer_marks
        if where is not None:
            where.extend(marks)
        return "".join(level)

    def lex(self, text: str) -> list[str]:
        if text.startswith("﻿"):
            text = text[1:]
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        first = re.match(r"[ \t\f]*(?:#[^\n]*)?(?=\n)", text)
        if first and first.end():
            text = text[first.end() :]
        tokens = self.rx.findall(text)
        if text[:1] in (" ", "\t") and tokens:
            tokens.insert(0, "\n" + re.match(r"[ \t]*", text).group(0))
        return tokens


def _python() -> Python:
    sets = {
        "I": "ident match case type".split(),
        "AugOp": "+= -= *= /= //= %= **= @= &= |= ^= <<= >>=".split(),
        "Comp": "== != < > <= >=".split(),
        "Bin": "| ^ & << >> + - * / // % @".split(),
        "Un": "+ - ~".split(),
        "Trail": ".".split(),
    }
    return Python("python", _PY_TOKENS, _PY_KEYWORDS, _PY_OPS, _PY_GRAMMAR, "Module", sets)


_MAKERS = {"javascript": lambda: _script(False), "typescript": lambda: _script(True), "go": _go, "java": _java, "python": _python}
#: Extension -> language, of the languages that have a grammar.
EXTENSIONS = {"ts": "typescript", "js": "javascript", "mjs": "javascript", "py": "python", "go": "go", "java": "java"}


@lru_cache(maxsize=None)
def language(name: str) -> Language:
    """One per worker process, with its memo."""
    return _MAKERS[name]()
