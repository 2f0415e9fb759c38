"""Credentials in source code and configuration: finding them, and masking them without breaking the code around them.

Quoted strings and long tokens are extracted together with what is written before them (a name, a header, a comment's
words, a URL's scheme). The Shannon entropy of each in its own alphabet is held against a threshold that is adjusted to its
length; what stands around a value only shifts the threshold. Digests, identifiers, references to where a value is kept, and
stand-ins are left out. Formats that issuers publish need pass only the laxest threshold, whatever they are called.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import spread

# Published token formats.
ISSUED = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[0-9A-Za-z]{30,}",
    r"github_pat_[0-9A-Za-z_]{40,}",
    r"glpat-[0-9A-Za-z_\-]{18,}",
    r"xox[abeoprs]-[0-9A-Za-z\-]{20,}",
    r"sk-[0-9A-Za-z_\-]{30,}",
    r"[rsp]k_(?:live|test)_[0-9A-Za-z]{16,}",
    r"AIza[0-9A-Za-z_\-]{30,}",
    r"ya29\.[0-9A-Za-z_\-]{20,}",
    r"SG\.[0-9A-Za-z_\-]{16,}\.[0-9A-Za-z_\-]{16,}",
    r"npm_[0-9A-Za-z]{30,}",
    r"pypi-[0-9A-Za-z_\-]{40,}",
    r"dop_v1_[0-9a-f]{40,}",
    r"hf_[0-9A-Za-z]{30,}",
    r"eyJ[0-9A-Za-z_\-]{8,}\.eyJ[0-9A-Za-z_\-]{8,}\.[0-9A-Za-z_\-]{8,}",
)
# Words for a secret in a name, as whole words of it.
SECRET_WORDS = frozenset("password passwd passwort passphrase pwd pass pw secret secrets token credential credentials creds cred apikey authtoken bearer auth login pat".split())
# Words that make a `key` a secret one.
KEY_WORDS = frozenset("api access secret private license licence signing sign encryption encrypt auth deploy master service account storage session shared client server admin root app application webhook hmac ssh tls ssl pem gpg pgp stripe aws gcp azure crypto cipher jwt".split())
# Words that make a name speak about a secret instead of holding one.
ABOUT_WORDS = frozenset("public hint field label title name names url uri path file dir length len count size id ids type header prefix suffix ttl expiry expires regex pattern placeholder message text help error prompt digest hash checksum fingerprint sha md5 integrity rotation limit max min kind env var column endpoint algorithm issuer audience enabled required strategy format".split())
# Stand-ins, compared in lower case without separators.
STAND_INS = frozenset("replaceme changeme changeit changethis fillme fillin fromenv fromvault fromconfig none null nil undefined empty unset notset todo tbd fixme redacted masked hidden removed omitted secret password passwd token key apikey yourpassword yourtoken yourkey yoursecret yourapikey example sample dummy placeholder test testing default insertkeyhere insecure".split())

#: Tokens beyond this length are data unless they are built like keys: at it any encoded data is as random as a key.
LONG = 400

#: What the context makes of the threshold: beside a name, header or comment of a secret, under a neutral name, and under a
#: name that speaks of something else.
NAMED, NEUTRAL, OTHER = 0.62, 0.92, 0.97
# Names of passwords, which people may choose of letters alone.
PASSWORD_WORDS = frozenset("password passwd passwort passphrase pwd pass pw".split())

_ISSUED = re.compile("|".join(ISSUED))
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.\-]{1,20}://([^\s/:@\"'`<>]*):([^\s/\"'`@]+|<[^>\s]+>|\$\{[^}\s]+\})@")
_PIECES = r"(?:[ \t]*(?:\+|\.|\\)?[ \t]*\r?\n?[ \t]*(?:\+|\.)?[ \t]*[rbuf]{0,2}%s)"
_Q = r"(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"
_ASSIGN = re.compile(
    r"(?P<name>[A-Za-z_$][\w.$\-]*)[\"'`]?(?:\])?[ \t]*(?:\?)?(?::[ \t]*(?:[A-Za-z_][\w.<>\[\]|& ]*?)[ \t]*)?(?P<op>:=|=>|==?|\|\|=|\?\?=|:|,)[ \t]*(?:\(?[ \t]*(?:\r?\n[ \t]*)?)"
    r"(?P<quoted>[rbuf]{0,2}" + _Q + "(?:" + _PIECES % _Q + r")*)"
)
_BARE = re.compile(r"(?m)^[ \t]*(?:export[ \t]+|set[ \t]+|-[ \t]+|ENV[ \t]+|ARG[ \t]+)?(?P<name>[A-Za-z_][\w.\-]*)[ \t]*(?:=|:[ \t]|:(?=\S)(?!/))[ \t]*(?P<value>[^\s\"'`#,;(){}\[\]][^\s\"'`;,(){}]*)[ \t]*(?:#[^\n]*)?\r?$")
_FLAG = re.compile(r"(?:(?<!\S)(?:-u|--user)[ =]\"?[^\s:\"'`]+:|(?<!\S)--?(?P<name>[A-Za-z][\w\-]*)[ =])(?P<value>[^\s\"'`]+)")
_SCHEME = re.compile(r"\b(?P<kind>[Bb]asic|[Bb]earer|[Tt]oken)[ \t]+(?P<value>[A-Za-z0-9+/=_\-.~]{8,})")
_CALL = re.compile(r"(?i)\b(?:\w+\.)*(?:log_?in|sign_?in|authenticate|auth|connect|set_?password|set_?credentials?|basic_?auth|credentials?|logon)\s*\(\s*" + f"({_Q})" + r"\s*,\s*" + f"({_Q})")
_COMMENT = re.compile(r"(?m)(?:^|(?<=[ \t;{}]))(?P<mark>//|#|/\*|--|;|\*|<!--)[ \t]*(?P<body>[^\n]*)")
_IN_COMMENT = re.compile(r"(?i)\b(?P<word>passwords?|passwd|pwd|pw|secret|tokens?|keys?|logins?|credentials?|creds?|api[ _-]?key)\b(?P<between>[^\n]{0,40}?)(?:->|=>|[:=]|\bis\b|\bwas\b|\s)[ \t]*[\"'`]?(?P<value>[^\s\"'`]{6,})[\"'`]?[ \t]*(?:\*/|-->)?[ \t]*\r?$")
_TOKEN = re.compile(r"[A-Za-z0-9+/_\-.!@#$%^&*?~]{16,}={0,2}")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_REFERENCE = re.compile(
    r"(?i)^(?:vault|file|env|secret|secrets|ssm|arn|gs|s3|op|azurekeyvault|keyvault|kms|config|ref|data|mailto|urn|https?|ftp|git|ssh-[a-z0-9]+|ecdsa-[a-z0-9\-]+)[:( ]|^\$|^%|^\{|^<|^@|^(?:process\.env|os\.environ|os\.getenv|system\.getenv|getenv|env\[|env\.|config\.|settings\.|self\.|this\.|import\.meta)|^/|^\.{1,2}/|^~/"
)
_DIGEST = re.compile(r"(?i)^(?:sha\d{1,3}|md5|blake\w*|crc32)\s*[:\-=]|^(?:sha(?:1|256|384|512))-")
_UUID = re.compile(r"(?i)^\{?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}\}?$")
_HOST = re.compile(r"(?i)^[a-z0-9\-]+(?:\.[a-z0-9\-]+)*\.(?:example|com|org|net|io|dev|local|internal|test|invalid|localhost)(?::\d+)?(?:/.*)?$")
_HEX = re.compile(r"(?i)^(?:0x)?[0-9a-f]+$")
# What any name of a secret or word of a comment holds; `pw` and `pat` in any spelling that name_kind() takes for words.
_NAMED = r"(?i:pass|pwd|secret|token|key|cred|auth|login|bearer)|(?<![a-z])(?:pw|pat)(?![a-z])|P(?:w|at)(?![a-z])|(?<![A-Z])P(?:W|AT)(?![a-z])|\bpW\b|(?i:(?:tls|ssl|pem|deploy|ssh)[\w.$\-]*data)"
_KEYED = re.compile(_NAMED)
# What any call of _CALL holds.
_CALLS = r"(?i:log_?in|log_?on|sign_?in|auth|connect|password|credential)"
_CALLED = re.compile(_CALLS)
# Between the pieces of a value, or the quotes of an empty one.
_JOINT = r"[\"'`][ \t]*[+.\\]?[ \t]*\r?\n?[ \t]*[+.]?[ \t]*[rbuf]{0,2}[\"'`]"
_PIECED = re.compile(_JOINT)
_ANY = re.compile(_NAMED + "|" + _CALLS + r"|(?i:basic)|://[^\s/:@]*:|-----BEGIN|-u[ =]|--user|[A-Za-z0-9+/=_\-.!@#$%^&*?~]{16}|" + _JOINT)


def entropy(s: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    return -sum(k / n * math.log2(k / n) for k in counts.values()) if n else 0.0


def threshold(s: str, shift: float) -> float:
    """About the entropy of a random string of this alphabet and length, of which shift is asked.

    A string of n characters can't exceed log2 n bits, and a random one over an alphabet of a characters stays below
    log2 a by about (a - 1) / (2 n ln 2).
    """
    if _HEX.match(s):
        a = 16
    elif s.isdigit():
        a = 10
    elif s.isalnum() and (s.islower() or s.isupper()):
        a = 36
    else:
        a = 64
    n = len(s)
    if n < 2:
        return 9.0
    most = min(math.log2(a), math.log2(n))
    expected = max(0.75 * most, min(math.log2(a) - (a - 1) / (2 * n * math.log(2)), math.log2(n) - 0.25))
    return expected * shift


@lru_cache(maxsize=100_000)
def name_kind(name: str) -> int:
    """1 if the name is that of a secret, -1 if it speaks about one or of something public, else 0."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words:
        return 0
    # A counted word, as in `booking_token4`, is a name by chance; the value then has to speak for itself.
    numbered = words[-1].isdigit()
    text = [w for w in words if not w.isdigit()]
    hit = any(w in SECRET_WORDS for w in text) or any(w in ("key", "keys") and i and text[i - 1] in KEY_WORDS for i, w in enumerate(text)) or text == ["key"] and not numbered
    joined = "".join(text)
    hit = hit or any(k in joined for k in ("password", "passwd", "apikey", "secretkey", "privatekey", "accesskey"))
    hit = hit or (len(text) > 1 and text[0] in ("tls", "ssl", "pem", "deploy", "ssh") and text[-1] in ("key", "data"))
    if not hit:
        return 0
    if any(w in ABOUT_WORDS for w in text):
        return -1
    return 0 if numbered else 1


def stand_in(v: str) -> bool:
    """Whether the value is masked, empty, a placeholder or a reference to where the value is kept."""
    if len(v) < 4 or _REFERENCE.search(v) or _DIGEST.search(v):
        return True
    if "${" in v or "$(" in v or "{{" in v or "<%" in v or v in ("%s", "%v", "%d") or re.fullmatch(r"<[^>]*>|\[[^\]]*\]|\{[^}]*\}|%\w+%|__\w+__", v):
        return True
    bare = re.sub(r"[\W_]+", "", v).lower()
    if not bare or bare in STAND_INS:
        return True
    core = re.sub(r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[a-z]-|sk-|[rsp]k_(?:live|test)_|AIza|SG\.|npm_|hf_)", "", v)
    run = re.sub(r"[\W_]+", "", core).lower()
    if not run or len(set(run)) <= 2 or len(set(core)) <= max(2, len(core) // 12):
        return True
    if re.search(r"(?i)(?:^|[-_. ])(?:your|my|some|the|an?)[-_. ](?:\w+[-_. ])?(?:password|token|key|secret|passwd|api)|change.?me|replace.?(?:me|this|with)|insert.?(?:here|your)|placeholder|redacted|x{6,}|\*{4,}|\.{3,}|…|(?:^|[-_.])(?:example|dummy|fake|sample)(?:$|[-_.])", v):
        return True
    return run in ("0123456789", "1234567890", "123456789", "12345678", "abcdefghijklmnopqrstuvwxyz", "abcdef", "abcdefgh")


def identifier(v: str) -> bool:
    """Whether the value is an id, a host, a path, a name made of words or a number rather than something random."""
    if _UUID.match(v) or _HOST.match(v) or v.isdigit() or re.fullmatch(r"[\d.\-: TZ+]+", v):
        return True
    if re.fullmatch(r"[A-Za-z]+(?:[_\-./:][A-Za-z]+)*", v):  # words without a digit
        parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", v)
        return not parts or sum(map(len, parts)) / len(parts) >= 3.2 or len(v) < 14
    return False


def wordy(v: str) -> bool:
    """Whether letters alone read like words: vowels in their usual share, and no long run without one."""
    vowels = sum(c in "aeiouyAEIOUY" for c in v)
    return 0.18 * len(v) <= vowels <= 0.7 * len(v) and not re.search(r"(?i)[^aeiouy\W\d_]{6}", v)


def chosen(v: str) -> bool:
    """Whether letters alone can be a password that somebody chose: several words written as one, none of them technical."""
    parts = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", v)]
    return len(v) >= 10 and v.isalpha() and len(parts) > 1 and not any(w in SECRET_WORDS or w in ABOUT_WORDS or w in KEY_WORDS or w in STAND_INS for w in parts)


def usable(v: str, shift: float, password: bool = False) -> bool:
    """Whether v can be a secret's value: its entropy is above the threshold that `shift` makes, and it is none of what is left
    out. password: it stands where a password does, so letters alone may be one."""
    if stand_in(v):
        return False
    if _ISSUED.fullmatch(v):
        return entropy(v) >= threshold(v, NAMED)
    if " " in v.strip() or _HOST.match(v) or _UUID.match(v) or entropy(v) < threshold(v, shift):
        return False
    if shift <= NAMED:
        if len(v) < 6:
            return False
        if identifier(v):
            return v.isdigit() and len(v) >= 8 or v.isalpha() and (not wordy(v) or password and chosen(v))
        return not v.isalpha() or not wordy(v) or password and chosen(v)
    if len(v) < 20 or _HEX.match(v) or identifier(v) or shift >= OTHER and len(v.rstrip("=")) in (22, 27, 43, 64, 86):
        return False
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", r"\d"))
    return kinds == 3 and not (re.search(r"[A-Za-z]{4,}[a-z]{3,}", re.sub(r"[a-z]{2}[A-Z]", "", v)) and entropy(v) < 4.2)


def attribute(v: str) -> bool:
    """Whether v is an attribute of something, made of words: config.token."""
    return re.fullmatch(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+", v) is not None and all(name_like(x) for x in v.split("."))


def name_like(x: str) -> bool:
    """Whether a name is made of words of some length, as programs' names are, and isn't random."""
    letters = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", x)
    return len(letters) > 0 and sum(map(len, letters)) >= 2.6 * len(letters) and sum(c.isdigit() for c in x) <= 0.3 * len(x)


def _is_password(name: str) -> bool:
    return any(w.lower() in PASSWORD_WORDS for w in _WORDS.findall(name))


def _unquote(q: str) -> tuple[str, list[tuple[int, int]]]:
    """The value of adjacent string literals, and where their insides stand in q."""
    spans, out = [], []
    for m in re.finditer(_Q, q):
        spans.append((m.start() + 1, m.end() - 1))
        out.append(m.group(0)[1:-1])
    return "".join(out), spans


def _basic(v: str) -> bool | None:
    """Whether the base64 of HTTP basic authentication holds a usable password; None if it isn't one."""
    try:
        user, sep, pw = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None
    return bool(sep) and usable(pw, NAMED, True) if sep else None


def key_body(v: str) -> bool:
    """Whether a long token is the body of a private key without its marks: DER in base64 or hex whose sequence is as long as
    it says and begins with a version, as those of private keys do and those of certificates and public keys don't, or the
    body of an OpenSSH key. Other long tokens are data: their entropy tells nothing."""
    if v.startswith("b3BlbnNzaC1rZXktdjEA"):
        return True
    if v[:2] != "MI" and v[:3] != "308":
        return False
    try:
        der = bytes.fromhex(v) if v[0] == "3" else base64.b64decode(v.rstrip("=").translate({45: 43, 95: 47}) + "=" * (-len(v.rstrip("=")) % 4), validate=True)
    except (binascii.Error, ValueError):
        return False
    size = der[1] - 128 if len(der) > 8 and der[0] == 0x30 and 0x81 <= der[1] <= 0x84 else 0
    return size > 0 and int.from_bytes(der[2 : 2 + size], "big") + 2 + size == len(der) and der[2 + size : 4 + size] == b"\x02\x01" and der[4 + size] <= 1


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each usable secret's value in text, in order, not overlapping.

    A value written in pieces gives a span a piece, of which all but the first have a kind that begins with '+'. A key
    block's span begins at its opening line; its markers stay when it is masked.
    """
    if not text or not _ANY.search(text):
        return []
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y in taken)

    def take(spans: list[tuple[int, int]], kind: str) -> None:
        for k, (a, b) in enumerate(spans):
            if b > a:
                found.append((a, b, kind if k == 0 else "+" + kind))
                taken.append((a, b))

    if "-----BEGIN" in text:
        for m in _PEM.finditer(text):
            end = _PEM_END.search(text, m.end())
            stop = end.start() if end else len(text)
            body = re.sub(r"\\n|\\r|[^A-Za-z0-9+/=]", "", text[m.end() : stop])
            if len(body) >= 32 and entropy(body) >= threshold(body, NAMED):
                found.append((m.start(), end.end() if end else len(text), "private_key"))
                taken.append((m.start(), end.end() if end else len(text)))
    if "://" in text:
        for m in _URL.finditer(text):
            a, b = m.span(2)
            pw = m.group(2)
            if free(a, b) and not stand_in(pw) and entropy(pw) >= threshold(pw, NAMED):
                take([(a, b)], "url_password")
            taken.append(m.span())
    keyed = _KEYED.search(text) is not None
    if keyed or "asic" in text:
        for m in _SCHEME.finditer(text):
            v = m.group("value")
            ok = _basic(v) if m.group("kind").lower() == "basic" else (usable(v, NAMED) and len(v) >= 12)
            if ok and free(*m.span("value")):
                take([m.span("value")], "authorization")
            elif ok is False:
                taken.append(m.span("value"))
    if keyed or _PIECED.search(text):
        for m in _ASSIGN.finditer(text):
            kind = name_kind(m.group("name"))
            if m.group("op") == ",":
                continue
            _, spans = _unquote(m.group("quoted"))
            if not kind and len(spans) == 1:
                continue  # judged below, as a token under a neutral name
            at = m.start("quoted")
            spans = [(at + x, at + y) for x, y in spans]
            if not free(spans[0][0], spans[-1][1]):
                continue
            # Adjacent literals may be pieces of one value, or the first may be all of it.
            for n in range(len(spans), 0, -1):
                v = "".join(text[x:y] for x, y in spans[:n])
                issued = _ISSUED.fullmatch(v) is not None
                if usable(v, NAMED if kind > 0 or issued else OTHER if kind < 0 else 9.0, _is_password(m.group("name"))) and (kind or n > 1 or issued):
                    take(spans[:n], "assignment")
                    break
            else:
                if kind:
                    taken.extend(spans)
    if keyed:
        for m in _BARE.finditer(text):
            if name_kind(m.group("name")) > 0 and free(*m.span("value")) and usable(m.group("value"), NAMED, _is_password(m.group("name"))) and not re.search(r"[()\[\]{}]|^(?:True|False|None|null|true|false)$", m.group("value")) and not attribute(m.group("value")):
                take([m.span("value")], "assignment")
    if keyed or "-u " in text or "-u=" in text or "--user" in text:
        for m in _FLAG.finditer(text):
            if (m.group("name") is None or name_kind(m.group("name")) > 0) and free(*m.span("value")) and usable(m.group("value"), NAMED):
                take([m.span("value")], "flag")
    if _CALLED.search(text):
        for m in _CALL.finditer(text):
            a, b = m.start(2) + 1, m.end(2) - 1
            if free(a, b) and usable(text[a:b], NAMED, True):
                take([(a, b)], "call")
    if keyed:
        for c in _COMMENT.finditer(text):
            if not _KEYED.search(c.group("body")):
                continue
            for m in _IN_COMMENT.finditer(text, c.start("body"), c.end("body")):
                a, b = m.span("value")
                v = m.group("value")
                if free(a, b) and usable(v, NAMED) and any(ch.isdigit() for ch in v) and not re.fullmatch(r"\w+\(.*|\d+|.*[,;]", v):
                    take([(a, b)], "comment")
    for m in _ISSUED.finditer(text):
        a, b = m.span()
        if free(a, b) and not stand_in(m.group(0)) and (a == 0 or not (text[a - 1].isalnum() or text[a - 1] in "_-/+.")):
            take([(a, b)], "issued")
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        if b - a < 20:
            continue
        v = m.group(0) if m.group(0)[-1] == "=" else m.group(0).strip(".-")
        at = a + m.group(0).find(v)
        before = text[max(0, a - 48) : at]
        quoted = at > 0 and text[at - 1] in "\"'`" and at + len(v) < len(text) and text[at + len(v)] in "\"'`"
        if not quoted and not re.search(r"[=:]\s*$", before):
            continue
        if name := re.search(r"([A-Za-z_$][\w.\-$]*)[\"'`]?\s*(?::\s*\w+\s*)?(?::=|=|:)\s*[\"'`]?$", before):
            words = {w.lower() for w in _WORDS.findall(name.group(1))}
            if words & {"integrity", "checksum", "digest", "hash", "sha", "sha256", "sha512", "md5", "etag", "commit", "fingerprint", "pixel", "icon", "image", "public", "pub", "signature", "nonce", "uuid", "id"}:
                continue
        if len(v) > LONG:
            if key_body(v) and free(at, at + len(v)):
                take([(at, at + len(v))], "entropy")
            continue
        if "/" in v and not re.search(r"[+=]", v) or "," in before[-3:] and not quoted:
            continue
        if free(at, at + len(v)) and usable(v, NEUTRAL):
            take([(at, at + len(v))], "entropy")
    found.sort()
    return found


def secret_lines(text: str) -> list[tuple[int, str]]:
    """(line, kind): lines, counted from 1, on which a secret's value begins."""
    out: dict[int, str] = {}
    for a, _, kind in find_secrets(text):
        if kind[0] != "+":
            out.setdefault(text.count("\n", 0, a) + 1, kind)
    return sorted(out.items())


def redact(text: str) -> str:
    """text with every secret's characters but line ends replaced by 'x': as long as before, with the same lines, and a
    value of the same syntactic kind. Of a key block the markers stay."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in find_secrets(text):
        if a < at:
            continue
        span = text[a:b]
        if kind == "private_key":
            head = _PEM.match(span).end()
            tail = _PEM_END.search(span)
            foot = tail.start() if tail else len(span)
            masked = span[:head] + re.sub(r"\\n|[A-Za-z0-9+/=]", lambda m: m.group(0) if m.group(0) == "\\n" else "x", span[head:foot]) + span[foot:]
        else:
            masked = "".join(c if c in "\r\n" else "x" for c in span)
        out += [text[at:a], masked]
        at = b
    return "".join(out) + text[at:]


def scan_secrets(df: DataFrame, id_col: str, content: str) -> DataFrame:
    """(id, line_no, kind): one row a line on which a secret's value begins, once however often the row was delivered.

    Null and empty contents yield none. Narrow but for the last distinct over the findings.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, line, kind) for i, t in zip(pdf["id"], pdf["t"]) for line, kind in secret_lines(t)]
            if rows:
                yield pd.DataFrame(rows, columns=["id", "line_no", "kind"])

    src = spread(df.select(F.col(id_col).cast("string").alias("id"), F.col(content).alias("t")).where("t is not null"))
    return src.mapInPandas(scan, "id string, line_no bigint, kind string").dropDuplicates(["id", "line_no"])


def redact_secrets(df: DataFrame, content: str, into: str | None = None) -> DataFrame:
    """df with the masked copy of `content` in column `into` (default: in its place). Null stays null."""

    @F.pandas_udf("string")
    def masked(t: pd.Series) -> pd.Series:
        return t.map(redact, na_action="ignore")

    return spread(df).withColumn(into or content, masked(F.col(content)))
