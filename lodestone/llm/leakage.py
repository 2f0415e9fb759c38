"""Evaluation texts that stand, in whole or in part, in training texts.

Both sides become words (longest runs of letters and digits, lower-cased) joined by one blank, so punctuation, case and line
breaks don't matter. By the q-gram lemma, a stretch of n characters with at most e edits shares at least n + 1 - q - q * e
q-grams with its original, and they lie on diagonals (document position less item position) at most e apart. Shared q-grams
are therefore counted in overlapping bands of diagonals; bands that reach the bound become regions, and a banded alignment
of each region verifies it. Of a region that fails as a whole, each part that reaches the bound is aligned by itself.

The items are a stated query set and mostly small. Their size is counted first: up to `SENT_CHARS` they are indexed in blocks
of bounded size, each of which is sent to all tasks and meets every document once, and no document's text leaves its task. A
larger set is divided into blocks too, but a document meets only those with which it shares a selected q-gram: of every window
of q-grams both sides select the one with the least hash, so that each stretch long enough for the lemma has one in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize, spread

#: Characters of item text in one block of the item index, the bound of what is broadcast.
BLOCK_CHARS = 8_000_000
#: Characters of all items together up to which their blocks are broadcast.
SENT_CHARS = 4 * BLOCK_CHARS
#: Shared q-grams that are held at a time.
HELD = 16_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


COLUMNS = ["doc_id", "item_id", "words", "distance", "item_chars", "passage"]
SCHEMA = "doc_id bigint, item_id bigint, words int, distance int, item_chars int, passage string"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram that begins at each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            h = (h * _BASE) ^ (codes[k : k + n] + np.uint64(0x632BE59BD9B4E019))
            h ^= h >> np.uint64(29)
    return h


@dataclass
class ItemIndex:
    """q-grams of a block of items, sorted by hash; positions count within each item's normalised text."""

    ids: list
    texts: list[str]
    q: int
    hashes: np.ndarray
    item: np.ndarray
    pos: np.ndarray

    @staticmethod
    def build(items: list[tuple[int, str]], q: int) -> ItemIndex:
        ids, texts, hs, it, ps = [], [], [], [], []
        for i, text in items:
            t = " ".join(words_of(text))
            h = _qgram_hashes(_codes([t]), q)
            if len(h):
                hs.append(h)
                it.append(np.full(len(h), len(ids), np.int32))
                ps.append(np.arange(len(h), dtype=np.int32))
            ids.append(i)
            texts.append(t)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        cat = lambda x: (np.concatenate(x) if x else np.zeros(0, np.int32))[order]
        return ItemIndex(ids, texts, q, h[order], cat(it), cat(ps))

    def part(self, lo: int, hi: int) -> ItemIndex:
        """The q-grams of the items lo to hi alone."""
        own = (self.item >= lo) & (self.item < hi)
        return ItemIndex(self.ids, self.texts, self.q, self.hashes[own], self.item[own], self.pos[own])


def banded_distance(a: str, b: str, limit: int) -> int:
    """The edit distance of a and b if it is at most `limit`, else limit + 1; only the diagonals within limit are filled."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if a == b:
        return 0
    ca, cb = _codes([a]), _codes([b])
    width = 2 * limit + 1
    far = limit + 1
    step = np.arange(width)
    # Cell k of a row is column i - limit + k; columns outside of b stay out of reach.
    pad = np.concatenate([np.full(limit, -1, np.int64), cb.astype(np.int64), np.full(2 * limit + 1, -1, np.int64)])
    row = np.where((step >= limit) & (step - limit <= len(b)), step - limit, far)
    for i in range(1, len(a) + 1):
        col = step + i - limit
        cost = (pad[i - 1 : i - 1 + width] != int(ca[i - 1])).astype(np.int64)
        best = np.minimum(row + cost, np.append(row[1:], far) + 1)
        best = np.where(col == 0, i, np.where((col < 0) | (col > len(b)), far, best))
        row = np.minimum.accumulate(best - step) + step
        row = np.where((col < 0) | (col > len(b)), far, np.minimum(row, far))
        if row.min() > limit:
            return far
    k = len(b) - len(a) + limit
    return int(min(row[k], far))


def find_regions(docs: list[str], index: ItemIndex, min_chars: int, edits: int, min_words: int = 0) -> list[tuple[int, int, int, int, int, int, np.ndarray, int, int]]:
    """(doc, item, doc start, doc end, item start, item end, hits, lowest, highest) of regions that reach the lemma's bound.

    hits: where in the document the region's shared q-grams begin, ascending; lowest, highest: their diagonals.

    docs are normalised. A region runs from the first to the last shared q-gram of its band; without edits it is a run of
    adjacent ones. A run of min_words words has its min_words - 1 blanks within its region, so regions with fewer are dropped.
    q-grams that very many items have are no danger: beyond HELD shared ones documents, and then items, are halved.
    """
    q = index.q
    need = min_chars + 1 - q - q * edits
    if need < 1:
        raise ValueError("q is too large for this length and edit budget")
    if not len(index.hashes):
        return []
    joined = _codes([d + "\0" for d in docs])
    lengths = np.array([len(d) + 1 for d in docs])
    starts = np.concatenate([[0], np.cumsum(lengths)])
    h = _qgram_hashes(joined, q)
    lo = np.searchsorted(index.hashes, h, "left")
    hit = lo < len(index.hashes)
    hit[hit] = index.hashes[lo[hit]] == h[hit]
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    lo = lo[at]
    n = np.searchsorted(index.hashes, h[at], "right") - lo
    if n.sum() > HELD:
        if len(docs) > 1:
            half = len(docs) // 2
            first = find_regions(docs[:half], index, min_chars, edits, min_words)
            return first + [(r[0] + half, *r[1:]) for r in find_regions(docs[half:], index, min_chars, edits, min_words)]
        low, high = int(index.item.min()), int(index.item.max()) + 1
        if high - low > 1:
            mid = (low + high) // 2
            return sorted((r for a, b in ((low, mid), (mid, high)) for r in find_regions(docs, index.part(a, b), min_chars, edits, min_words)), key=lambda r: r[:6])
    which = np.repeat(np.arange(len(at)), n)
    slot = np.repeat(lo, n) + (np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n))
    item = index.item[slot].astype(np.int64)
    doc = (np.searchsorted(starts, at, "right") - 1)[which]
    # The lemma's bound holds for a document and an item as a whole before it holds for a band.
    pair = doc * len(index.ids) + item
    _, which_pair, shared = np.unique(pair, return_inverse=True, return_counts=True)
    keep = np.flatnonzero(shared[which_pair] >= need)
    if not len(keep):
        return []
    doc, item, slot, doc_at = doc[keep], item[keep], slot[keep], at[which[keep]]
    dpos = doc_at - starts[doc]
    ipos = index.pos[slot].astype(np.int64)
    blanks = np.concatenate([[0], np.cumsum(joined == 32)])
    width = 2 * edits + 1
    diagonal = dpos - ipos
    out: dict[tuple, tuple[np.ndarray, int, int]] = {}
    for shift in (0, edits) if edits else (0,):
        # Bands of width 2e + 1 that overlap by half: whatever lies within e diagonals falls into one of them whole.
        band = (diagonal + shift) // width
        low = band.min()
        order = np.argsort((doc * len(index.ids) + item) * (band.max() - low + 1) + (band - low), kind="stable")
        d, i, b, p, ip = doc[order], item[order], band[order], dpos[order], ipos[order]
        gap = min_chars + q if edits else 1
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1]) | (p[1:] - p[:-1] > gap)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(d)]]) - 1
        enough = (last - first + 1) >= need
        if min_words and not edits:
            a, b = starts[d[first]] + p[first], starts[d[first]] + p[last] + q
            enough &= blanks[b] - blanks[a] >= min_words - 1
        for f, e in zip(first[enough].tolist(), last[enough].tolist()):
            key = (int(d[f]), int(i[f]), int(p[f]), int(p[e]) + q, int(ip[f : e + 1].min()), int(ip[f : e + 1].max()) + q)
            lean = p[f : e + 1] - ip[f : e + 1]
            hits, low_d, high_d = p[f : e + 1], int(lean.min()), int(lean.max())
            if key in out:  # the other shift's band has the same ends
                was = out[key]
                hits, low_d, high_d = np.union1d(was[0], hits) if len(was[0]) != len(hits) or (was[0] != hits).any() else hits, min(low_d, was[1]), max(high_d, was[2])
            out[key] = (hits, low_d, high_d)
    return [(*key, *out[key]) for key in sorted(out)]


def _edges(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a normalised text begin, and where they end."""
    at = np.array([m.span() for m in re.finditer(r"[^ ]+", text)], np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def find_parts(docs: list[str], index: ItemIndex, regions: list[tuple], min_chars: int, edits: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """(doc, item, doc start, doc end, item start, item end, distance) of passages within regions.

    A passage has at least min_chars characters and at most `edits` edits, begins and ends with words in which both agree,
    and is the longest of those that begin there and end with the min_chars-th character's word or one of the `edits`
    after it. All that reach the lemma's bound are aligned, side by side.
    """
    q, need = index.q, min_chars + 1 - index.q * (edits + 1)
    edges: dict[tuple[str, int], tuple] = {}

    def words(side: str, n: int, text: str) -> tuple:
        if (side, n) not in edges:
            edges[side, n] = _edges(text)
        return edges[side, n]

    begin: dict[tuple[int, int, int, int], int] = {}  # (doc, item, start, start) -> the rows that are needed
    for d, i, _, _, _, _, hits, low, high in regions:
        text, item = docs[d], index.texts[i]
        first, last = words("d", d, text)
        item_first, item_last = words("i", i, item)
        a, b = np.searchsorted(first, [hits[need - 1] + q - min_chars, hits[len(hits) - need] + 1])
        for k in range(int(a), int(b)):
            s = int(first[k])
            x, y = np.searchsorted(hits, [s, s + min_chars - q + 1])
            end = int(np.searchsorted(last, s + min_chars))
            if y - x < need or end == len(last):
                continue
            word = text[s : int(last[k])]
            u, v = np.searchsorted(item_first, [s - high - edits, s - low + edits + 1])
            for t, z in zip(item_first[u:v].tolist(), item_last[u:v].tolist()):
                if item[t:z] == word:
                    begin[d, i, s, t] = int(last[min(end + edits, len(last) - 1)]) - s
    out = []
    todo = sorted(begin, key=lambda w: (begin[w], w))
    for at in range(0, len(todo), 4096):
        out += _align_parts(docs, index, todo[at : at + 4096], begin[todo[min(at + 4096, len(todo)) - 1]], min_chars, edits, words)
    return out


def _align_parts(docs: list[str], index: ItemIndex, todo: list[tuple[int, int, int, int]], rows: int, min_chars: int, edits: int, words) -> list[tuple[int, int, int, int, int, int, int]]:
    """The passages of find_parts that begin at `todo`, aligned over `rows` characters of the documents."""
    width = 2 * edits + 1
    a = np.full((len(todo), rows), -1, np.int64)
    b = np.full((len(todo), rows + 2 * edits), -2, np.int64)
    for n, (d, i, s, t) in enumerate(todo):
        x, y = _codes([docs[d][s : s + rows]]), _codes([index.texts[i][t : t + rows + edits]])
        a[n, : len(x)] = x
        b[n, edits : edits + len(y)] = y
    step = np.arange(width)
    row = np.tile(np.where(step >= edits, step - edits, edits + 1), (len(todo), 1))
    which = np.arange(len(todo))
    best: dict[int, tuple[int, int, int]] = {}
    for k in range(1, rows + 1):
        # Cell c of a row is column k - edits + c; what is over `edits` stays over it.
        up = np.full_like(row, edits + 1)
        up[:, :-1] = row[:, 1:]
        row = np.minimum(row + (b[:, k - 1 : k - 1 + width] != a[:, k - 1 : k]), up + 1)
        row = np.minimum(np.minimum.accumulate(row - step, axis=1) + step, edits + 1)
        if k % 8 == 0 or k >= min_chars:
            alive = row.min(axis=1) <= edits
            if not alive.all():
                a, b, row, which = a[alive], b[alive], row[alive], which[alive]
            if not len(which):
                break
        if k >= min_chars:
            for n, r in zip(which.tolist(), row):
                d, i, s, t = todo[n]
                text, item = docs[d], index.texts[i]
                if s + k > len(text) or s + k < len(text) and text[s + k] != " " or text[s + k - 1] == " ":
                    continue
                word = text[text.rfind(" ", 0, s + k) + 1 : s + k]
                for c in np.flatnonzero(r <= edits).tolist():
                    z = t + k - edits + c
                    if z <= len(item) and (z == len(item) or item[z] == " ") and item[item.rfind(" ", 0, z) + 1 : z] == word and (n not in best or best[n][0] < k or best[n][2] > r[c]):
                        best[n] = (k, z, int(r[c]))
    return [(todo[n][0], todo[n][1], todo[n][2], todo[n][2] + k, todo[n][3], z, dist) for n, (k, z, dist) in sorted(best.items())]


def _joined_parts(docs: list[str], index: ItemIndex, parts: list[tuple], min_chars: int, edits: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """The passages of find_parts, those that overlap as one where they are within the bound together."""
    last: list[tuple] = []
    for part in [*sorted(parts), None]:
        if last and (part is None or part[:2] != last[-1][:2] or part[2] > max(x[3] for x in last)):
            d, i = last[0][:2]
            d0, d1, i0, i1 = last[0][2], max(x[3] for x in last), min(x[4] for x in last), max(x[5] for x in last)
            limit = edits * -(-(d1 - d0) // min_chars)
            dist = banded_distance(docs[d][d0:d1], index.texts[i][i0:i1], limit)
            yield (d, i, d0, d1, i0, i1, dist) if dist <= limit else max(last, key=lambda x: (x[3] - x[2], -x[6]))
            last = []
        if part is not None:
            last.append(part)


def shared_run(doc: list[str], item: list[str]) -> int:
    """The most consecutive words that both have."""
    best, row = 0, [0] * (len(item) + 1)
    where: dict[str, list[int]] = {}
    for j, w in enumerate(item):
        where.setdefault(w, []).append(j)
    prev: dict[int, int] = {}
    del row
    for w in doc:
        cur = {j: prev.get(j - 1, 0) + 1 for j in where.get(w, ())}
        if cur:
            best = max(best, max(cur.values()))
        prev = cur
    return best


def whole_words(text: str, a: int, b: int, item: str, c: int) -> tuple[int, int]:
    """text[a:b], which equals item from c on, cut to the words that are whole in both."""
    end = c + b - a
    if text[a:b].startswith(" "):
        a += 1
    elif a and text[a - 1] != " " or c and item[c - 1] != " ":
        a = text.find(" ", a, b) + 1 or b
    if b > a and (b < len(text) and text[b] != " " or end < len(item) and item[end] != " "):
        b = text.rfind(" ", a, b)
        b = a if b < 0 else b
    return (a, b - 1) if b > a and text[b - 1] == " " else (a, b)


def _widen(text: str, a: int, b: int) -> tuple[int, int]:
    """[a, b) grown to word ends."""
    while a > 0 and text[a - 1] != " ":
        a -= 1
    while b < len(text) and text[b] != " ":
        b += 1
    return a, b


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", min_words: int = 13, edits: int = 0, q: int = 12, min_chars: int | None = None, sent_chars: int = SENT_CHARS) -> DataFrame:
    """(doc_id, item_id, words, distance, item_chars, passage): one row for each document and each item that it gives away.

    With edits = 0: the document shares `min_words` or more consecutive words with the item, `words` is how many at most: a region
    counts if its alignment has no edit and holds so many whole words.
    With edits = e: a region of at least `min_chars` characters that begins and ends with words in which both agree, with at
    most e edits for each min_chars characters begun; `words` is then the longest exact run, and `distance` the region's edit distance.
    `passage` is the longest verified region of the document, normalised.

    Without min_chars the bound is that of the shortest possible run: min_words words of one letter. Null and empty texts give away nothing,
    an item of fewer words than min_words can't be found, empty tables give no rows, a repeated row counts once.
    """
    min_chars = min_chars or 2 * min_words - 1
    if q + q * edits > min_chars:
        raise ValueError("q * (edits + 1) must not exceed the least length")
    own = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(doc_text).alias("t")).where("t is not null")
    queries = items.select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).alias("t")).where("t is not null and i is not null").distinct()
    spark = docs.sparkSession
    size = queries.agg(F.sum(F.length("t"))).first()[0] or 0

    def scan(pdf: pd.DataFrame, idx: ItemIndex) -> pd.DataFrame:
        best = _leaks(pdf["d"].tolist(), [" ".join(words_of(t)) for t in pdf["t"]], idx, min_chars, edits, min_words)
        return pd.DataFrame(list(best.values()), columns=COLUMNS)

    if size > sent_chars:
        # A stretch without an edit of so many characters lies in every region; q-grams are selected in windows of it.
        window = (min_chars - edits) // (edits + 1) - q + 1
        found = _meetings(own, queries, q, window, max(1, -(-2 * size // BLOCK_CHARS)))

        def meet(texts: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
            if not len(texts) or not len(block):
                return pd.DataFrame(columns=COLUMNS, dtype=object)
            return scan(texts, ItemIndex.build(list(zip(block["i"].tolist(), block["t"])), q))

        return found[0].cogroup(found[1]).applyInPandas(meet, SCHEMA).dropDuplicates(["doc_id", "item_id"])

    own = spread(own)
    parts = []
    for block in _blocks(queries):
        sent = spark.sparkContext.broadcast(ItemIndex.build(block, q))

        def each(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = scan(pdf, sent.value)
                if len(out):
                    yield out

        parts.append(own.mapInPandas(each, SCHEMA))
    if not parts:
        return spark.createDataFrame([], SCHEMA)
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.dropDuplicates(["doc_id", "item_id"])


def _leaks(ids: list[int], norm: list[str], idx: ItemIndex, min_chars: int, edits: int, min_words: int) -> dict[tuple[int, int], tuple]:
    """(doc, item) -> the row of SCHEMA with the longest run: the alignment of each region decides."""
    item_words: dict[int, list[str]] = {}
    best: dict[tuple[int, int], tuple] = {}

    def keep(row: tuple) -> None:
        old = best.get(row[:2])
        if old is None or (row[2], row[4]) > (old[2], old[4]):
            best[row[:2]] = row

    def run_of(passage: str, i: int) -> int:
        if i not in item_words:
            item_words[i] = idx.texts[i].split()
        return shared_run(passage.split(), item_words[i])

    a = 0
    while a < len(norm):
        b, size = a, 0
        while b < len(norm) and (b == a or size + len(norm[b]) < 2_000_000):
            size += len(norm[b])
            b += 1
        failed = []
        for region in find_regions(norm[a:b], idx, min_chars, edits, min_words):
            d, i, d0, d1, i0, i1 = region[:6]
            text, item = norm[a + d], idx.texts[i]
            if not edits:
                if banded_distance(text[d0:d1], item[i0:i1], 0) == 0:
                    d0, d1 = whole_words(text, d0, d1, item, i0)
                    run = text.count(" ", d0, d1) + 1 if d1 > d0 else 0
                    if run >= min_words:
                        keep((ids[a + d], idx.ids[i], run, 0, d1 - d0, text[d0:d1]))
                continue
            d0, d1 = _widen(text, d0, d1)
            if d1 - d0 < min_chars:
                failed.append(region)
                continue
            i0, i1 = _widen(item, i0, i1)
            limit = edits * max(1, -(-(d1 - d0) // min_chars))
            dist = banded_distance(text[d0:d1], item[i0:i1], limit + abs((d1 - d0) - (i1 - i0)))
            run = run_of(text[d0:d1], i)
            if run >= min_words or dist <= limit:
                keep((ids[a + d], idx.ids[i], run, dist, i1 - i0, text[d0:d1]))
            else:
                failed.append(region)
        if failed:
            docs_ = norm[a:b]
            for d, i, d0, d1, i0, i1, dist in _joined_parts(docs_, idx, find_parts(docs_, idx, failed, min_chars, edits), min_chars, edits):
                passage = docs_[d][d0:d1]
                keep((ids[a + d], idx.ids[i], run_of(passage, i), dist, i1 - i0, passage))
        a = b
    return best


def selected(text: str, q: int, window: int) -> np.ndarray:
    """The distinct least hashes of all windows of so many adjacent q-grams of a normalised text."""
    h = _qgram_hashes(_codes([text]), q)
    if len(h) < window:
        return h[:0]
    return np.unique(np.lib.stride_tricks.sliding_window_view(h, window).min(axis=1))


def _meetings(docs: DataFrame, items: DataFrame, q: int, window: int, blocks: int) -> tuple:
    """Documents (d, t) and items (i, t), grouped so that each document meets the blocks of items with which it shares a
    selected q-gram. A hot q-gram is split by the join's skew handling; what it leads to is one row a document and block. The
    documents of one block are divided among tasks by their number."""

    def hashes(name: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                each = [selected(" ".join(words_of(t)), q, window).view(np.int64) for t in pdf["t"]]
                yield pd.DataFrame({name: np.repeat(pdf[name].to_numpy(), [len(x) for x in each]), "h": np.concatenate(each) if each else np.zeros(0, np.int64)})

        return run

    block = F.pmod(F.xxhash64("i"), F.lit(blocks)).cast("int").alias("block")
    of_items = items.mapInPandas(hashes("i"), "i bigint, h bigint").select("h", block).distinct()
    of_docs = spread(docs.where("d is not null")).mapInPandas(hashes("d"), "d bigint, h bigint")
    pairs = materialize(of_docs.join(of_items, "h").select("d", "block").distinct(), "leak-candidates")
    few = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / 2_000).cast("int").alias("salts"))  # a row a block of items
    left = docs.join(pairs, "d").join(few, "block").select("block", F.pmod(F.xxhash64("d"), F.col("salts")).cast("int").alias("salt"), "d", "t")
    right = items.withColumn("block", block).join(few, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "i", "t")
    return left.groupBy("block", "salt"), right.groupBy("block", "salt")


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, whose size is bounded, in blocks of at most BLOCK_CHARS characters (or one item)."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        if block and size + len(r["t"]) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((r["i"], r["t"]))
        size += len(r["t"])
    if block:
        yield block
