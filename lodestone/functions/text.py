"""Column functions on texts, names and identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_CHARS = 4
MAX_CHUNK_TOKENS = 2000
VECTOR_DIM = 384
TOKEN_IDS = 30522
MAX_TOKENS = 512


def content_hash(text: Column) -> Column:
    """SHA-256 of the text's UTF-8, in hex."""
    return F.sha2(text.cast("binary"), 256)


def count_tokens(text: Column) -> Column:
    """A token is four characters (code points), rounded up."""
    return F.ceil(F.length(text) / TOKEN_CHARS).cast("bigint")


def exceeds_tokens(text: Column, limit: int = MAX_CHUNK_TOKENS) -> Column:
    return count_tokens(text) > limit


def truncate_to_tokens(text: Column, limit: int) -> Column:
    return F.substring(text, 1, limit * TOKEN_CHARS)


def first_line(text: Column, width: int = 120) -> Column:
    """A chunk's signature: its first line without outer blanks, at most `width` characters."""
    return F.substring(F.trim(F.split(text, "\n")[0]), 1, width)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, both included."""
    return F.array_join(F.slice(F.split(text, "\n"), start, F.greatest(end - start + 1, F.lit(0))), "\n")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def symbol_id(path: Column, qualified: Column) -> Column:
    return F.concat(path, F.lit("#"), qualified)


def qualified_name(parent: Column, name: Column) -> Column:
    return F.concat_ws(".", parent, name)


def strip_quotes(text: Column) -> Column:
    """Without one pair of equal outer quotes, single, double or backticks."""
    return F.regexp_replace(text, "^(['\"`])(.*)\\1$", "$2")


def module_path(dotted: Column) -> Column:
    """A relative dotted module as a path: one leading dot is this folder, each further one goes up."""
    dots = F.length(F.regexp_extract(dotted, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(dotted, r"^\.+", ""), r"\.", "/")
    up = F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0)))
    return F.when(dots == 0, rest).when(dots == 1, F.concat(F.lit("./"), rest)).otherwise(F.concat(up, rest))


def strip_annotation(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"^:\s*", ""))


def is_relative_import(path: Column) -> Column:
    return path.startswith("./") | path.startswith("../") | path.startswith("/")


def glob_regex(pattern: str) -> str:
    """The regular expression of a file pattern: ** spans folders, * doesn't, all else is literal."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out.append(".+")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/]*")
            i += 1
        else:
            out.append(re.escape(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"


def glob_match(path: Column, pattern: str) -> Column:
    """A pattern without '/' is tested on the file's name, else on the whole path."""
    subject = path if "/" in pattern else F.substring_index(path, "/", -1)
    return subject.rlike(glob_regex(pattern))


def project_slug(root: str) -> str:
    """A folder's name made safe, with six hex digits of the path's hash."""
    import hashlib

    name = re.sub(r"[^A-Za-z0-9_-]", "_", root.rstrip("/").rsplit("/", 1)[-1]) or "root"
    return f"{name}-{hashlib.sha256(root.encode()).hexdigest()[:6]}"


def embedding_input(signature: Column, content: Column, width: int = 2000) -> Column:
    """What is embedded of a chunk: its signature and content, the first `width` characters."""
    return F.substring(F.concat(signature, F.lit("\n"), content), 1, width)


def token_ids(text: Column, limit: int = MAX_TOKENS) -> Column:
    """Ids of a text's words by a rolling hash, at most `limit`."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def one(w: Column) -> Column:
        codes = F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
        return F.aggregate(codes, F.lit(0).cast("bigint"), lambda h, c: (h * 31 + c).bitwiseAND(65535)) % TOKEN_IDS

    return F.transform(F.slice(words, 1, limit), one)


def placeholder_embedding(text: Column, dim: int = VECTOR_DIM) -> Column:
    """A unit vector made of the bytes of the text's SHA-256, repeated: equal for equal texts, needing no model."""
    # Each intermediate array is bound to a lambda's variable, else it would be made anew for every element.
    full, rest = divmod(dim, 32)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)

    def scaled(b: Column) -> Column:
        # Of the whole vector each byte stands dim / 32 times, the first dim % 32 once more.
        norm = F.sqrt(square(b) * full + (square(F.slice(b, 1, rest)) if rest else F.lit(0.0)))
        unit = F.transform(F.array(norm), lambda n: F.transform(b, lambda x: x / n))[0]
        return F.transform(F.array(unit), lambda u: F.slice(F.flatten(F.array_repeat(u, full + 1)), 1, dim))[0]

    def bytes_of(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)

    return F.transform(F.transform(F.array(content_hash(text)), bytes_of), scaled)[0]


def like_prefix(name: Column, query: str) -> Column:
    """Whether a name begins with query in any case; % and _ in query are wildcards, a backslash is literal."""
    return name.ilike(query.replace("\\", "\\\\") + "%")
