"""Packrat parsing of token streams by parsing expression grammars.

A source is lexed into one character per token kind. Brackets (and indented blocks) are folded into single group characters,
bottom-up, and equal groups share one: so the packrat memo, whose key is the rule and what it reads, holds across all files
that a worker sees, and a shape that recurs is parsed once. Within a level the memo's key is the rule and the position.

Grammar notation, a rule a line: `Name <- a b / c`, with 'token', `@Set` (a named set of tokens), `Rule`, `( )`, suffixes
? * +, prefixes & and !, `.` any token, `$` the end of the level, and `P{R}` `K{R}` `B{R}` `D{R}`: a parenthesis, bracket, brace or
indented group whose whole inside is an R. A rule marked with `:=` instead of `<-` is also memoised by the tokens it reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Group characters: 0x10000 groups of each kind before a worker's memo starts afresh.
ROOM = 0x30000
BASE = {"P": 0x10000, "K": 0x10000 + ROOM, "B": 0x10000 + 2 * ROOM, "D": 0x10000 + 3 * ROOM}
#: Tokens that a rule's memo by content may read.
WINDOW = 64
ERROR = "\x00"


class Vocabulary:
    """Token texts and kinds as single characters."""

    def __init__(self, kinds: dict[str, str]):
        self.kinds = dict(kinds)  # kind name -> character
        self.tokens: dict[str, str] = {}
        self._next = 0x100

    def token(self, text: str) -> str:
        if text in self.kinds:
            return self.kinds[text]
        if text not in self.tokens:
            self.tokens[text] = chr(self._next)
            self._next += 1
        return self.tokens[text]


class Grammar:
    """A compiled grammar; parse() answers whether a level's string is an instance of a rule as a whole."""

    def __init__(self, text: str, vocabulary: Vocabulary, sets: dict[str, list[str]]):
        self.voc = vocabulary
        self.sets = {k: frozenset(vocabulary.token(t) for t in v) for k, v in sets.items()}
        self.rules: dict[str, Callable] = {}
        self.by_content: set[str] = set()
        self.source: dict[str, str] = {}
        self.inner: dict[str, str] = {}
        self.groups: dict[tuple[str, str], str] = {}
        self.next = dict(BASE)
        self.whole: dict[tuple[str, str], bool] = {}
        self.far: dict[tuple[str, str], int] = {}
        self.content: dict[tuple[str, int, str], int] = {}
        self.lengths: dict[tuple[str, str], list[int]] = {}
        for line in re.sub(r"\n[ \t]+/", " /", text).splitlines():
            line = line.split("  ##")[0].strip()
            if not line:
                continue
            m = re.match(r"(\w+)\s*(<-|:=)\s*(.*)$", line)
            if not m:
                raise ValueError(f"not a rule: {line}")
            self.source[m.group(1)] = m.group(3)
            if m.group(2) == ":=":
                self.by_content.add(m.group(1))
        self._memo: dict[tuple[str, int], tuple[int, int]] = {}
        self._seen = 0
        for name, body in self.source.items():
            self.rules[name] = self._rule(name, self._compile(body))

    # Interning of groups ------------------------------------------------------------------------------------------------

    def fresh(self, at_once: bool = False) -> None:
        """Forget the memo when its room is used up, or at once; only between files."""
        if at_once or any(self.next[k] - BASE[k] > ROOM - 20_000 for k in BASE) or len(self.content) > 400_000:
            self.inner.clear()
            self.groups.clear()
            self.whole.clear()
            self.far.clear()
            self.content.clear()
            self.lengths.clear()
            self.next = dict(BASE)

    def group(self, kind: str, inner: str) -> str:
        key = (kind, inner)
        c = self.groups.get(key)
        if c is None:
            n = self.next[kind]
            if n - BASE[kind] >= ROOM:
                raise MemoryError("a file has too many different groups")
            c = self.groups[key] = chr(n)
            self.next[kind] = n + 1
            self.inner[c] = inner
        return c

    # Parsing ------------------------------------------------------------------------------------------------------------

    def parse(self, rule: str, s: str) -> tuple[bool, int]:
        """Whether all of s is a `rule`, and the furthest position at which parsing failed."""
        memo, seen = self._memo, self._seen
        self._memo, self._seen = {}, 0
        try:
            j = self.rules[rule](s, 0)
            ok = j == len(s)
            return ok, -1 if ok else min(len(s), max(self._seen - 1, j, 0))
        finally:
            self._memo, self._seen = memo, seen

    def _inside(self, rule: str, c: str) -> bool:
        key = (rule, c)
        ok = self.whole.get(key)
        if ok is None:
            ok, far = self.parse(rule, self.inner[c])
            self.whole[key] = ok
            if not ok:
                self.far[key] = far
        return ok

    def _rule(self, name: str, body: Callable) -> Callable:
        by_content = name in self.by_content
        content = self.content
        lengths = self.lengths

        def run(s: str, i: int) -> int:
            memo = self._memo
            key = (name, i)
            hit = memo.get(key)
            if hit is not None:
                j, read = hit
                if read > self._seen:
                    self._seen = read
                return j
            if by_content:
                # What a rule reads from here on decides its result; how far it read is known from the same beginning.
                start = (name, s[i : i + 3])
                for n in lengths.get(start, ()):
                    hit = content.get((name, n, s[i : i + n]))
                    if hit is not None:
                        j = -1 if hit < 0 else i + hit
                        read = i + n
                        memo[key] = (j, read)
                        if read > self._seen:
                            self._seen = read
                        return j
            outer, self._seen = self._seen, i
            j = body(s, i)
            read = self._seen
            # A look past the level's end shows as a slice that is shorter than its length.
            if by_content and read - i <= WINDOW:
                n = read - i
                content[(name, n, s[i : i + n])] = -1 if j < 0 else j - i
                known = lengths.get(start)
                if known is None:
                    lengths[start] = [n]
                elif n not in known:
                    known.append(n)
            memo[key] = (j, read)
            if outer > read:
                self._seen = outer
            return j

        return run

    # Compiling ----------------------------------------------------------------------------------------------------------

    _LEX = re.compile(r"\s*(?:('(?:[^'])+')|(@\w+)|([PKBD])\{(\w+)\}|(\w+)|([()?*+&!./$]))")

    def _compile(self, body: str) -> Callable:
        tokens = []
        at = 0
        body = body.strip()
        while at < len(body):
            m = self._LEX.match(body, at)
            if not m:
                raise ValueError(f"can't read {body[at:]!r}")
            tokens.append(m.groups())
            at = m.end()
        self._tokens, self._at = tokens, 0
        f = self._choice()
        if self._at != len(tokens):
            raise ValueError(f"unbalanced: {body}")
        return f

    def _peek(self) -> str | None:
        return self._tokens[self._at][5] if self._at < len(self._tokens) else ")"

    def _choice(self) -> Callable:
        options = [self._sequence()]
        while self._peek() == "/":
            self._at += 1
            options.append(self._sequence())
        if len(options) == 1:
            return options[0]
        options = tuple(options)

        def choice(s: str, i: int) -> int:
            for f in options:
                j = f(s, i)
                if j >= 0:
                    return j
            return -1

        return choice

    def _sequence(self) -> Callable:
        parts = []
        while self._at < len(self._tokens) and self._peek() not in ("/", ")"):
            parts.append(self._item())
        if len(parts) == 1:
            return parts[0]
        parts = tuple(parts)

        def sequence(s: str, i: int) -> int:
            for f in parts:
                i = f(s, i)
                if i < 0:
                    return -1
            return i

        return sequence

    def _item(self) -> Callable:
        sign = self._peek()
        if sign in ("&", "!"):
            self._at += 1
            f = self._item()
            if sign == "&":
                return lambda s, i: i if f(s, i) >= 0 else -1
            return lambda s, i: -1 if f(s, i) >= 0 else i
        f = self._atom()
        while self._at < len(self._tokens) and self._peek() in ("?", "*", "+"):
            f = self._repeat(f, self._peek())
            self._at += 1
        return f

    @staticmethod
    def _repeat(f: Callable, sign: str) -> Callable:
        if sign == "?":

            def maybe(s: str, i: int) -> int:
                j = f(s, i)
                return j if j >= 0 else i

            return maybe

        def loop(s: str, i: int) -> int:
            n = 0
            while True:
                j = f(s, i)
                if j < 0 or j == i:
                    return i if n or sign == "*" else (j if j == i else -1)
                i = j
                n += 1

        return loop

    def _atom(self) -> Callable:
        text, named, kind, inside, rule, sign = self._tokens[self._at]
        self._at += 1
        if text is not None:
            return self._one(frozenset(self.voc.token(t) for t in text[1:-1].split()))
        if named is not None:
            return self._one(self.sets[named[1:]])
        if kind is not None:
            lo, hi = chr(BASE[kind]), chr(BASE[kind] + ROOM)
            whole = self.whole

            def group(s: str, i: int) -> int:
                if i >= self._seen:
                    self._seen = i + 1
                if i < len(s) and lo <= (c := s[i]) < hi:
                    ok = whole.get((inside, c))
                    if ok is None:
                        ok = self._inside(inside, c)
                    return i + 1 if ok else -1
                return -1

            return group
        if rule is not None:
            rules = self.rules
            return lambda s, i: rules[rule](s, i)
        if sign == "(":
            f = self._choice()
            self._at += 1
            return f
        if sign == ".":
            return self._any
        if sign == "$":

            def end(s: str, i: int) -> int:
                if i >= self._seen:
                    self._seen = i + 1
                return i if i == len(s) else -1

            return end
        raise ValueError(f"unexpected {sign}")

    def _any(self, s: str, i: int) -> int:
        if i >= self._seen:
            self._seen = i + 1
        return i + 1 if i < len(s) else -1

    def _one(self, chars: frozenset[str]) -> Callable:
        if len(chars) == 1:
            (only,) = chars

            def single(s: str, i: int) -> int:
                if i >= self._seen:
                    self._seen = i + 1
                return i + 1 if i < len(s) and s[i] == only else -1

            return single

        def one(s: str, i: int) -> int:
            if i >= self._seen:
                self._seen = i + 1
            return i + 1 if i < len(s) and s[i] in chars else -1

        return one
