"""Records without real content: unfilled templates, filler, and the messages of error, refusal, notice and empty pages.

Lines are normalised and counted by host over all records; lines that recur on a host are boilerplate and are taken away
from a record before it is judged, together with the page's frame (navigation, footers, link lists, diagnostic fields). What
remains, the residual, is read sentence by sentence. Quoted text, code and citations say nothing about the record itself. A
record is excluded if its residual holds evidence and next to nothing else, or if there is next to no residual and the
boilerplate that is its all holds such evidence.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, spread

#: A line is boilerplate on a host if it stands in this share of the host's records, and in this many at least.
SHARE, LEAST = 0.002, 6

#: Recurrent lines of all hosts are broadcast up to this number (some 20 MB), beyond it they are joined.
LISTED = 200_000

#: A sign in a sentence speaks for so many words on either side of it.
REACH = 45

#: Running text with an open slot in at most so many words is a template.
SLOT_WORDS = 40

# Evidence of an error, refusal or notice, in English, German, French and Spanish.
ERROR = (
    r"^(?:(?:http|error|fehler|erreur|status|code)[ :/]*)*(?:4\d\d|5\d\d)\b(?:[ :\-–|]+[\w' \-]{0,50})?[.!]?$",
    r"\brequested (?:path|url|page|file|resource|document)\b|\b(?:does not|doesn't) exist on this server\b|\b(?:file|page|content|preview|image|diff|notebook) (?:could not|cannot|can't|couldn't) be (?:displayed|loaded|rendered|shown|opened|found)\b|\b(?:failed|unable) to (?:load|fetch|render|display)\b",
    r"\b(?:error|fehler|erreur|c[óo]digo) (?:4\d\d|5\d\d)\b",
    r"\bwhoops, that's a \d",
    r"^(?:not found|forbidden|unauthori[sz]ed|gone|bad gateway|bad request|service unavailable|gateway time-?out|too many requests|internal server error|access denied|permission denied|method not allowed|request timeout|payload too large)[.!]?$",
    r"\b(?:page|file|site|document|url|resource|repository) (?:(?:that |which )?you (?:are|were) looking for |(?:that |which )?you requested )?(?:was|is|could|can|cannot|can't|couldn't|has been|does not|doesn't)\b.{0,40}\b(?:not (?:be )?found|moved|removed|renamed|exist|unavailable|empty|deleted)",
    r"\b(?:page|seite|página|pagina) (?:not found|nicht gefunden|introuvable|no encontrada)",
    r"\b(?:internal server error|interner serverfehler|erreur interne (?:est survenue|du serveur)|error interno del servidor|une erreur (?:est survenue|s'est produite)|ein fehler ist aufgetreten|se ha producido un error|ha ocurrido un error)",
    r"\b(?:something went wrong|an (?:unexpected |unknown |internal )?error (?:has )?occurred|we're having trouble|we are having trouble)\b",
    r"\b(?:access (?:to this (?:page|resource|site) )?(?:is |was |has been )?denied|zugriff verweigert|accès (?:refusé|interdit)|acceso denegado|zugang verweigert)\b",
    r"\byou (?:don't|do not) have (?:permission|access|the rights?)\b|\byou are not (?:allowed|authori[sz]ed|permitted) to\b|\bkeine berechtigung\b|\bpermission denied\b|\bask an owner for access\b|\brequest access\b",
    r"\b(?:rate limit exceeded|too many requests|quota exceeded|wait and retry|try again in \d+|(?:please )?try again later|versuchen sie es (?:später|in)|réessayer plus tard|inténtelo (?:más tarde|de nuevo)|intente(?:lo)? más tarde)\b",
    r"\b(?:session (?:has )?(?:expired|timed out)|log in again|sign in to (?:continue|see|view)|please (?:log|sign) in|you must be logged in|you need to (?:log|sign) in|bitte melden sie sich an|veuillez vous connecter|inicie sesión)\b",
    r"\b(?:down for (?:scheduled )?maintenance|under maintenance|scheduled maintenance|be back (?:soon|shortly)|wartungsarbeiten|en maintenance|en mantenimiento)\b",
    r"\bupstream connect error\b|\bdisconnect/reset before headers\b|\bconnection (?:refused|reset|timed out|failure)\b|\bgateway could not reach\b|\bbad gateway\b|\bservice (?:is )?(?:temporarily )?unavailable\b|\breset reason\b|\bquote the incident\b|^generated at \d",
    r"\bgo back to the home ?page\b|\b(?:zurück zur startseite|retour à l'accueil|volver al inicio)\b",
    r"\bchecking (?:your browser|if the site connection is secure)\b|\bverify (?:that )?you are (?:a )?human\b|\bare you a (?:human|robot)\b|\bunusual traffic\b|\bcomplet(?:e|ing) the (?:captcha|action below)|\bthis may take a few seconds\b|\bray(?: id)?:? [0-9a-f]{8,}|\bddos protection\b|\byour (?:ip|request|access) (?:address )?(?:has been|was|is) blocked\b|\bautomated (?:access|queries)\b|^just a moment\b|\byour connection is secure\b",
    r"\bcookies (?:are|must be) (?:switched off|turned off|disabled|blocked|enabled)\b|\b(?:enable|allow|accept) (?:all )?cookies\b|\bwe need them to keep you\b|\bpress reload\b|\bour partners use cookies\b|^(?:accept|reject|allow|decline) all[.!]?$|^manage (?:choices|preferences|cookies|settings)[.!]?$|\bwe use cookies\b|\bcookies verwenden\b|\butilis(?:ons|e) des cookies\b|\busa(?:mos)? cookies\b",
)
# Evidence that a script was required.
SCRIPT = (
    r"\b(?:enable|activate|turn on|allow|aktivieren sie|activer|active|activez|habilite)\b.{0,30}\b(?:javascript|java script|scripts?)\b",
    r"\b(?:javascript|scripts?)\b.{0,60}\b(?:disabled|required|needed|must be enabled|turned off|switched off|blocked|is off|eingeschaltet|aktiviert|deaktiviert|désactivé|activé|desactivado|necesario|requis)\b",
    r"\b(?:requires?|needs?|necesita|benötigt|nécessite|erfordert) (?:javascript|scripts?)\b",
    r"\bscript that your browser did not run\b|\byour browser (?:is|does) not support|\bupgrade or activate\b|\bfor full functionality\b|\bturn (?:it|them) on in your browser\b|\bbrowser settings and reload\b|^loading\.{2,3}|\bscripts may be blocked\b|^noscript\b",
)
# An empty page, or values that weren't rendered.
EMPTY = (
    r"^(?:no (?:content|results?|data|posts?|items?|entries|records?)(?: (?:available|found|yet|to (?:show|display)))?|nothing (?:here|to see here|found)(?: yet)?|this (?:page|section|article|folder|directory|list|repository) (?:is (?:empty|intentionally left blank)|has no (?:text|content)(?: yet)?)|kein inhalt(?: verfügbar)?|aucun contenu(?: disponible)?|sin contenido|noch kein text|seite leer)[.!]?$",
    r"^this (?:repository|folder|project) is empty\b",
    r"^(?:(?:undefined|null|nan|none|\[object object\]|of|\s)+)$",
)
# Placeholders that stand for a text to be written.
PLACEHOLDER = (
    r"^[\[(<*_]*(?:tbd|tba|tbc|todo|to ?do|n/a|coming soon|under construction|work in progress|wip|fill (?:me )?in|to be (?:filled in|written|defined|determined|done|completed|announced|added)|not yet written|in bearbeitung|folgt(?: in kürze)?|à compléter|à venir|por completar|próximamente|en construcción|en construction|baustelle|demnächst)[\])>*_.!…:]*$",
    r"^todo:? (?:write|add|fill|describe|complete|document|replace|update|insert)\b.{0,40}(?:section|here|this|text|description|me|later|content|readme)[.!]?$",
    r"^<!--.*-->$",
    r"^_?no (?:description|summary|details?|readme|documentation|text)(?: (?:provided|given|available|yet))+_?[.!]?",
    r"\b(?:your|ihr|votre|su|tu) (?:text|texte|texto|content|title|heading|name|description|message)\b.{0,12}\b(?:here|goes here|ici|aquí|hier)\b|\bhier steht ihr text\b|\bsu texto aquí\b|\btext (?:goes )?here\b",
    r"\b(?:heading|title|text|content|caption|description|copy|image|paragraph) goes here\b|^sample (?:caption|heading|title|text|paragraph|page|post)[.!]?$|\bthis is (?:a|an) (?:sample|example|placeholder|dummy) (?:paragraph|text|page|post|heading)\b|\breplace (?:it|this)(?: text)? with your own\b|\bclick (?:here )?to (?:edit|add|change)\b|\b(?:write|say|tell us) something about (?:yourself|you|your)|\bedit this text\b|\bdescribe your changes\b|\blink to (?:the )?(?:ticket|issue) here\b|^summary of changes$",
    r"\bhello,? world\b.{0,20}\bfirst post\b|\bjust another (?:wordpress|blog)\b",
    r"^this section has no text yet[.!]?$",
)
# The vocabulary of Latin filler.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt incidunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud nostrum exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat fugit nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim anima id est laborum vidi vitae vel at".split()
)
# What hands type to fill a field.
MASH = frozenset("asdf asd asdfasdf qwer qwerty qwert zxcv jkl hjkl foo bar baz qux quux blah bla xxx yyy zzz abc abcd xyz test tests testing 123 1234 12345 aaa bbb dummy fill filler text lala dfgh sdf".split())

# Names of slots in templates.
SLOT_NAMES = r"(?:(?:your|the|insert|my|project|company|user|first|last|full|file|repo|package|short|long|feature|ticket|issue|pr|release|due)[ _\-]?)*(?:name|title|email|e-mail|mail|date|owner|author|version|license|licence|url|link|repo|repository|project|company|feature|ticket|summary|description|address|phone|city|country|product|number|id|text|value|topic|category|tags?|keyword|username|password|contact|maintainer|team|organi[sz]ation|year|month|day|time|price|amount|location|role|department|subject|body|content|here)(?:[ _\-]?(?:here|name|id|url|goes here))*"
_N = rf"\s*{SLOT_NAMES}\s*"
_SLOT = re.compile(
    rf"(?i)\{{\{{{{1,2}}[^{{}}\n]{{1,40}}\}}\}}{{1,2}}|\{{%{_N}%\}}|<%=?{_N}%>|[$#]\{{{_N}\}}|\$\({_N}\)|%{_N}%|@@{_N}@@|__{SLOT_NAMES}__|\[\[{_N}\]\]|\{{{_N}\}}|\[(?:(?:your|insert|enter|add)\b[^\[\]\n]{{1,40}}|{_N})\](?!\()|<(?:insert|your|enter)\b[^<>\n]{{1,40}}>|&lt;{_N}&gt;|<{_N}>|\bXX{SLOT_NAMES}XX\b"
)
_EVIDENCE = [(k, p, re.compile(p, re.I)) for k, ps in (("script", SCRIPT), ("empty", EMPTY), ("placeholder", PLACEHOLDER), ("error", ERROR)) for p in ps]


def literals(parsed) -> set[str] | None:
    """Strings of which every text that a parsed pattern matches has one at least, case folded; None if there are none.

    Of a sequence the part counts whose shortest string is the longest; of alternatives all do.
    """
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            run += chr(arg)
            continue
        if run:
            offer({run.casefold()})
            run = ""
        if op == "BRANCH":
            each = [literals(x) for x in arg[1]]
            offer(None if any(x is None for x in each) else set().union(*each))
        elif op == "SUBPATTERN":
            offer(literals(arg[-1]))
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            offer(literals(arg[2]))
        elif op == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            offer({chr(v).casefold() for _, v in arg})
    if run:
        offer({run.casefold()})
    return best


def _index() -> tuple[ahocorasick.Automaton, tuple[int, ...]]:
    """(an automaton from strings to the patterns that need one of them, patterns that need none)."""
    where: dict[str, list[int]] = {}
    free = []
    for i, (_, p, _) in enumerate(_EVIDENCE):
        found = literals(_parser.parse(p, re.I))
        for x in found or ():
            where.setdefault(x, []).append(i)
        if not found:
            free.append(i)
    a = ahocorasick.Automaton()
    for x, ids in where.items():
        a.add_word(x, tuple(ids))
    a.make_automaton()
    return a, tuple(free)


_NEEDED, _FREE = _index()


def sign(s: str) -> str | None:
    """The kind of the first pattern that a sentence matches. Only those whose strings stand in it are tried."""
    some = {i for _, ids in _NEEDED.iter(s.casefold()) for i in ids}
    return next((_EVIDENCE[i][0] for i in sorted(some.union(_FREE)) if _EVIDENCE[i][2].search(s)), None)


_FENCE = re.compile(r"(?ms)^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[^\n]*$|\Z)")
_QUOTED = re.compile(r"`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|(?<!\w)'[^'\n]{3,}'(?!\w)|‘[^’\n]*’")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+(?=[^\s])")
_FOOT = re.compile(
    r"(?i)^(?:back to top|nach oben|haut de page|volver arriba|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|contact (?:support|us)|kontakt|terms|privacy(?: policy)?|imprint|impressum|cookie (?:policy|settings)|powered by .{1,30}|(?:©|\(c\)|copyright)\b.{0,60}|skip to (?:main )?content|menu|share|subscribe|follow us|home|search|sign in|log in|sign up|help|docs|blog|pricing|explore|status|careers|press|about(?: us)?|next|previous|read more|load more|go back|reload|retry|ok)[.!]?$"
)
_SERVER = re.compile(r"(?i)^[a-z][\w\-]{1,20}/\d+(?:\.\d+)*(?: \([\w ]+\))?$")
_DIAGNOSTIC = re.compile(r"(?i)^[a-z][\w \-]{1,24}[:=] ?(?:#?[0-9a-f]{4,}|\d[\d.:\- TZ]*(?:utc)?|[\w\-]{16,})$|^(?:ref|id|code|ray)[=: ]+[0-9a-z\-]{3,}$")
_ITEM = re.compile(r"^\s*[*\-+•]\s+(\S+(?:\s+\S+){0,2})\s*$")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:import|def|class|return|func|package|const|let|var|public|private|protected|while|try|except|catch|switch|case)\b(?!.*[.!?]$)|^\s*(?:#include|@\w+|\"\"\"|log\.|\}|\))|^\s*[\w.\[\]]+\s*(?:=|:=|\+=)\s*\S|\w\(.*\)\s*[;:]?\s*$|=>"
)
_WORD = re.compile(r"[^\W\d_][\w'’]*|\d+")
# Names in an error's answer that belong to the error.
_TOLD = re.compile(r"(?i)err|exception|code|status|messag|detail|trace|stack|cause|reason|descri|title|type|hint|debug|path|instance|timestamp|request|documentation|help|meta")


@dataclass
class Verdict:
    kind: str | None
    evidence_words: int
    content_words: int
    told: str | None = None  # the kind of most of the evidence, whether it decides or not


_LINE_END = re.compile(r"\r\n|\n|\r")
_HEADING = re.compile(r"^(?:#{1,6}\s+|\*\*|={2,}\s*)")
_LEAD = re.compile(r"^(?:#{1,6}\s+|\*\*|[*\-+•]\s+|\d+[.)]\s+)|\*\*$")
_CLOSED = re.compile(r"[.!?:]$")
_TITLE = re.compile(r"^[A-ZÄÖÜÉ][\w' ]*$")
_SLOTTED = "{<%$[@_X#&"


def _is_nav(line: str) -> bool:
    if len(line) >= 160 or not any(c in line for c in "|·»>-/•"):
        return False
    for sep in ("|", " · ", " » ", " > ", " - ", " / ", " • "):
        parts = [p.strip() for p in line.split(sep)]
        if len(parts) >= 3 and all(p and len(p.split()) <= 3 and not p.endswith(".") for p in parts) and len(line) < 160:
            return True
    return False


def _filler(words: list[str]) -> bool:
    if len(words) < 4:
        return False
    latin = sum(map(LATIN.__contains__, words))
    mash = sum(w in MASH or w == w[0] * len(w) and len(w) > 2 for w in words)
    return latin >= 0.7 * len(words) or mash >= 0.7 * len(words) or len(words) >= 12 and len(set(words)) <= 2


def _reached(s: str, words: int) -> int:
    """How many of a long sentence's words lie within REACH words of a sign in it."""
    ends = [m.start() for m in _WORD.finditer(s)]
    near = [False] * words
    for _, _, rx in _EVIDENCE:
        for m in rx.finditer(s):
            a, b = bisect_left(ends, m.start()), bisect_left(ends, m.end())
            near[max(0, a - REACH) : b + REACH] = [True] * (min(words, b + REACH) - max(0, a - REACH))
    return sum(near)


@lru_cache(maxsize=1 << 16)
def _sentence(s: str) -> tuple[str | None, int, int]:
    """(kind, evidence words, content words) of a sentence."""
    words = [w.lower() for w in _WORD.findall(s)]
    n = len(words)
    hit = sign(s)
    if hit is None and n and _filler(words):
        return "filler", n, 0
    if hit:
        near = n if n <= REACH else _reached(s, n)
        return hit, max(1, near), n - near
    if n <= 4 and not _CLOSED.search(s) and _TITLE.match(s) and not _CODE_LINE.search(s):
        return None, 0, 0  # a short title
    return None, 0, n


@lru_cache(maxsize=1 << 16)
def _line(raw: str) -> tuple[bool, int, int, tuple[tuple[str | None, int, int], ...]]:
    """(frame, slots, evidence of slots, sentences) of a line that isn't code, a citation or an item of a link list."""
    line = raw.strip()
    if _is_nav(line) or len(line) < 90 and (_FOOT.match(line) or _SERVER.match(line) or _DIAGNOSTIC.match(line)):
        return True, 0, 0, ()
    bare = _QUOTED.sub(" ", line)
    body = _LEAD.sub("", bare).strip()
    found = len(_SLOT.findall(bare)) if any(c in bare for c in _SLOTTED) else 0
    if found:
        n = len(_WORD.findall(_SLOT.sub(" ", body)))
        if n == 0 or not _CODE_LINE.search(_SLOT.sub(" x ", bare)) or re.search(r"[.!?,]$", line):
            return (False, found, n + 2 * found, ()) if n <= 8 * found else (False, found, 0, ((None, 0, n),))
    if _HEADING.match(line) and len(_WORD.findall(_SLOT.sub(" ", body))) <= 6 and sign(body) is None:
        return False, 0, 0, ()
    return False, 0, 0, tuple(_sentence(s) for s in map(str.strip, _SENTENCE.split(body)) if s and not _is_nav(s))


def _judge_lines(lines: list[str], whole: bool = False) -> Verdict:
    """What these lines are. whole: read on also where that can't change the kind."""
    text = "\n".join(lines)
    words = len(_WORD.findall(text))
    slots_at_most = sum(map(text.count, _SLOTTED))
    if _SLOT.search(text):
        prose = _QUOTED.sub(" ", _FENCE.sub(" ", text))
        open_slots = len(_SLOT.findall(prose))
        if open_slots:
            kept = [ln for ln in prose.split("\n") if ln.strip()]
            coded = sum(1 for ln in kept if _CODE_LINE.search(_SLOT.sub("x", ln)))
            n = len(_WORD.findall(_SLOT.sub(" ", prose))) + words - len(_WORD.findall(prose))
            if coded <= 0.3 * len(kept) and n <= SLOT_WORDS * open_slots:
                return Verdict("template", n + open_slots, 0, "template")
    # No record has more evidence than this: each word once, each slot twice and once more for a word that it parts, each
    # sentence without a word once. With more content than that evidence could outweigh the rest needn't be read.
    most = words + 3 * slots_at_most + len(lines) + sum(map(text.count, ".!?…"))
    fenced: set[int] = set()
    if "```" in text or "~~~" in text:
        for m in _FENCE.finditer(text):
            a = text.count("\n", 0, m.start())
            fenced.update(range(a, a + m.group(0).rstrip("\n").count("\n") + 1))
    links = sum(1 for ln in lines if _ITEM.match(ln))
    kinds: dict[str, int] = {}
    evidence = content = slots = frame = 0
    for i, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            continue
        if content > max(3, 0.34 * most) and not whole:
            return Verdict(None, evidence, content)
        if i in fenced or line[0] == ">":  # code, or a citation
            content += len(_WORD.findall(line))
            continue
        if links >= 4 and _ITEM.match(raw) and not _SLOT.search(line):
            frame += 1
            continue
        is_frame, found, told, sentences = _line(raw)
        frame += is_frame
        slots += found
        if told:
            kinds["template"] = kinds.get("template", 0) + told
            evidence += told
        for hit, e, c in sentences:
            content += c
            if hit:
                kinds[hit] = kinds.get(hit, 0) + e
                evidence += e
    told = max(kinds, key=kinds.get) if kinds else None
    if slots and kinds.get("template") and evidence >= 3 * content:
        return Verdict("template", evidence, content, told)
    if evidence and content <= max(3, 0.2 * evidence):
        return Verdict(told, evidence, content, told)
    if not evidence and not content and frame >= 2:
        return Verdict("empty", 0, 0)
    return Verdict(None, evidence, content, told)


def judge(text: str, recurrent: frozenset[int] = frozenset()) -> Verdict:
    """What a record is. recurrent: numbers of its lines that recur on its host, from 0; they are taken away first.

    A record in JSON is one value and no sequence of lines, so it is read as a whole. Marks of code blocks and lines without
    a word stay, as they are structure. Numbers of words are those of the residual.
    """
    if not text or not text.strip():
        return Verdict(None, 0, 0)
    if _json_error(text):
        return Verdict("error", len(_WORD.findall(text)), 0)
    rest: list[str] = []
    boilerplate: list[str] = []
    for i, ln in enumerate(_LINE_END.split(text)):
        shed = i in recurrent and not ln.lstrip().startswith(("```", "~~~")) and _WORD.search(ln)
        (boilerplate if shed else rest).append(html.unescape(ln) if "&" in ln else ln)
    own = _judge_lines(rest)
    if own.kind or not boilerplate:
        return own
    if own.content_words <= 3 and (told := _judge_lines(boilerplate, whole=True).told):
        return Verdict(told, own.evidence_words, own.content_words)
    return own


def _json_words(value) -> int:
    if isinstance(value, dict):
        return sum(map(_json_words, value.values()))
    if isinstance(value, list):
        return sum(map(_json_words, value))
    return len(_WORD.findall(value)) if isinstance(value, str) else 0


def _json_error(text: str) -> bool:
    """Whether the record is nothing but an error answer in JSON, however long: what stands beside the error is no content."""
    t = text.strip()
    if t[:1] != "{" or t[-1:] != "}" or not re.search(r'(?i)"(?:error|errors|code|status|message|detail)"', t):
        return False
    try:
        d = json.loads(t)
        inner = d.get("error", d.get("errors", d))
        parts = [d, *([inner] if isinstance(inner, dict) else [])]
        codes = [str(p.get(k, "")) for p in parts for k in ("code", "status", "statusCode", "status_code")]
        if len(d) > 6 or not (d.get("error") or d.get("errors") or any(re.fullmatch(r"[45]\d\d", c) for c in codes)):
            return False
        told = sum(_json_words(v) for k, v in d.items() if _TOLD.search(k))
        return _json_words(d) - told <= max(40, told)
    except (ValueError, RecursionError):
        return False


def line_hashes(text):
    """A hash of each line of a text in one spelling: lower case, digits as 0, blanks evened out; null for blank lines."""
    even = F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), r"[^\S\r\n]+", " ")
    return F.transform(F.split(even, r"\r\n|\n|\r"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def recurrent_lines(df: DataFrame, id_col: str, host: str, text: str, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(host, line): hashes of the lines that recur on each host.

    Each text of an id counts once. Texts don't leave their tasks, only the hashes of their lines do, and counts are
    pre-aggregated before the shuffle, so a host or line with a third of all rows is no hot key. A host has at most 1 / share
    times as many recurrent lines as its records have lines on average.
    """
    src = df.select(F.col(id_col).alias("id"), F.col(host).alias("host"), F.xxhash64(text).alias("t"), F.array_compact(F.array_distinct(line_hashes(F.col(text)))).alias("lines"))
    once = src.groupBy("id", "t").agg(F.min(F.coalesce("host", F.lit(""))).alias("host"), F.first("lines").alias("lines"))
    # The null line counts the host's records.
    each = once.select("host", F.explode(F.array_append("lines", F.lit(None).cast("bigint"))).alias("line"))
    count = materialize(each.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) | F.col("line").isNull()), "residue-lines")
    size = count.where("line is null").select("host", F.col("n").alias("n_host"))
    return count.where("line is not null").join(size, "host").where(F.col("n") >= share * F.col("n_host")).select("host", "line")


def find_residue(df: DataFrame, id_col: str = "doc_id", host: str = "repo", text: str = "text", listed: int = LISTED) -> DataFrame:
    """(id, kind, evidence_words, content_words) of records without real content.

    kind: template, placeholder, filler, error, script or empty. Null and blank texts are none; a null host is a host of
    its own; of repeated ids each different text is judged. A very long text is read whole.

    Up to `listed` recurrent lines, which are counted first, are broadcast, and no text is shuffled. More are joined: to the
    lines' hashes, spread over 16 salts, and then once to the texts.
    """
    src = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.col(text).alias("text")).where("trim(text) != ''")
    often = recurrent_lines(src, "id", "host", "text")
    dtype = dict(src.dtypes)["id"]
    schema = f"id {dtype}, kind string, evidence_words int, content_words int"
    few = often.limit(listed + 1).collect()

    def found(ids, texts, numbers) -> pd.DataFrame:
        rows = [(i, v.kind, v.evidence_words, v.content_words) for i, t, ls in zip(ids, texts, numbers) if (v := judge(t, ls)).kind]
        return pd.DataFrame(rows, columns=["id", "kind", "evidence_words", "content_words"])

    if len(few) <= listed:
        known: dict[str, set[int]] = {}
        for r in few:
            known.setdefault(r["host"], set()).add(r["line"])
        sent = df.sparkSession.sparkContext.broadcast(known)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = sent.value
            for pdf in batches:
                own = (known.get(h, ()) for h in pdf["host"])
                numbers = (frozenset(k for k, x in enumerate(hs.tolist()) if x in o) if o else frozenset() for hs, o in zip(pdf["lines"], own))
                yield found(pdf["id"], pdf["text"], numbers)

        return spread(src).withColumn("lines", F.transform(line_hashes(F.col("text")), lambda x: F.coalesce(x, F.lit(0)))).mapInPandas(scan, schema).distinct()

    each = src.select("id", F.xxhash64("text").alias("t"), "host", F.posexplode(line_hashes(F.col("text"))).alias("line_no", "line")).where("line is not null")
    salts = often.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(16)])))
    hit = each.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(salts, ["host", "line", "salt"], "left_semi")
    marks = hit.groupBy("id", "t").agg(F.collect_set("line_no").alias("lines"))
    marked = src.withColumn("t", F.xxhash64("text")).join(marks, ["id", "t"], "left").select("id", "text", "lines")

    def scan_marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield found(pdf["id"], pdf["text"], (frozenset(x) if x is not None else frozenset() for x in pdf["lines"]))

    return marked.mapInPandas(scan_marked, schema).distinct()
