"""Mixing sources to target shares of the total size.

A classifier is trained on a bounded sample of labelled records (multinomial naive Bayes on hashed words). It gives each
record a posterior over the sources, as sure as it proves right on held-out records, to which the record's own label contributes
as an observation that is wrong at a given rate: membership is soft. A record's rate, how often it is used on average, is its membership times a
factor a source. Expected totals are then linear in the factors, and their matrix, the moments of membership weighted by size,
is summed over all records in one distributed pass; projected gradient descent on the squared distance between expected totals
and targets needs nothing else. Further passes, eight at most, put right what the caps of single records take away. Rates
become whole repeats by a hash of the record's id and a threshold a source, chosen from a histogram over all records so that
rounding leaves each source's total as it was fitted. Shares are reported by the records' own labels and by membership.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled records, over all sources, on which the classifier is trained.
TRAIN_ROWS = 20_000
#: Hashed features of the classifier.
FEATURES = 1 << 14
#: How often a record's own label is taken to be wrong.
LABEL_NOISE = 0.002
#: A source that could keep its share only in a mix smaller than this part of all tokens is reported as infeasible.
LEAST_SIZE = 0.1
#: Passes that put right what single records' caps take away, and steps of the projected gradient between them.
PASSES, STEPS = 8, 20_000
#: A factor may be so many times its source's cap: records that are only in part a source's would else stay below the cap that
#: they have in any case.
SLACK = 4.0
#: Bins of the histogram by which rounding is put right.
BINS = 1024
#: The public vocabulary that counts tokens, and the pattern that goes with it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORD = re.compile(r"[^\W\d_]{2,}|[^\w\s]")
_encoders: dict[str, object] = {}


def _encoder(path: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(text: str, path: str = VOCABULARY) -> int:
    """Tokens of the whole text."""
    return len(_encoder(path).encode_ordinary(text))


def source_key(c: Column) -> Column:
    """Sources are compared without regard to case and outer blanks."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def _features(text: str) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % FEATURES for w in _WORD.findall(text.lower())), np.int64)


def likelihoods(counts: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihoods, log priors) of multinomial naive Bayes, from feature counts and numbers of records a source; a source
    without records gets a flat likelihood."""
    c, n = counts + 0.1, records + 1.0
    return np.log(c / c.sum(axis=1, keepdims=True)).astype(np.float32), np.log(n / n.sum())


def evidence(text: str, like: np.ndarray) -> np.ndarray:
    """Log likelihoods of the text, scaled down to those of 20 words, as words aren't independent."""
    f = _features(text)
    return like[:, f].sum(axis=1) * min(1.0, 20 / len(f)) if len(f) else np.zeros(len(like))


def _log_softmax(s: np.ndarray) -> np.ndarray:
    s = s - s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Classifier:
    """Likelihoods and priors, the factor by which evidence has to be scaled so that posteriors are as sure as they are right,
    and how often labels are taken to be wrong."""

    like: np.ndarray
    prior: np.ndarray
    scale: float = 1.0
    noise: float = LABEL_NOISE

    def membership(self, found: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Membership in each source, row by row, given the texts' evidence and the labels."""
        s = _log_softmax(self.prior + self.scale * found)
        k = s.shape[1]
        off = np.log(self.noise / max(1, k - 1))
        s = s + off
        s[np.arange(len(s)), label] += np.log(1 - self.noise) - off
        return np.exp(_log_softmax(s))

    def calibrated(self, found: np.ndarray, label: np.ndarray) -> Classifier:
        """With the scale under which held-out labels are likeliest, given the texts alone."""
        if not len(label):
            return self
        rows = np.arange(len(label))
        scale = max(np.geomspace(0.02, 4.0, 40), key=lambda t: _log_softmax(self.prior + t * found)[rows, label].mean())
        return replace(self, scale=float(scale))


def fit(moments: np.ndarray, want: np.ndarray, most: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Factors x, 0 <= x <= most, with the least squared distance of moments @ x to want, by projected gradient."""
    scale = np.maximum(want, 1.0)
    a, b = moments / scale[:, None], want / scale
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    x = np.clip(start, 0.0, most)
    for _ in range(STEPS):
        new = np.clip(x - step * (a.T @ (a @ x - b)), 0.0, most)
        if np.abs(new - x).max(initial=0.0) < 1e-10:
            return new
        x = new
    return x


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY, least_size: float = LEAST_SIZE, label_noise: float = LABEL_NOISE) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: (doc_id, source, tokens, repeats) of each record used at least once, repeats at most its source's max_repeats.
    shares: (source, target_share, max_repeats, feasible, wanted_share, reached_share, member_share, tokens, documents, uses) of
    every source of targets. reached_share goes by the records' labels, member_share by their membership.

    targets has source, target_share, max_repeats, a few rows. Records of no listed source, and null or empty ones, take no
    part; a redelivered row counts once, of different rows under one id the one of the first source and least size counts. The
    mix is as large as all feasible sources' shares allow. A source that could keep its share only in a mix of less than
    `least_size` of all tokens, or is absent, isn't feasible: it is used to its most, and wanted_share tells what the others'
    shares are then, in proportion. With least_size = 0 only absent sources are infeasible. With no records at all chosen is
    empty and every share 0. The greater label_noise, the more a text outweighs its label, and the further the shares by label
    lie from those by membership, which are what is fitted.
    """
    from lodestone.session import materialize, spread

    spark = docs.sparkSession
    goal = targets.select(source_key(F.col("source")).alias("source"), "target_share", "max_repeats").groupBy("source").agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*").orderBy("source").toPandas()
    names = goal["source"].tolist()
    k = len(names)
    share = goal["target_share"].to_numpy(float) / max(goal["target_share"].sum(), 1e-12)
    cap = goal["max_repeats"].fillna(0).clip(lower=0).to_numpy(int)
    where = {n: i for i, n in enumerate(names)}
    used = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), source_key(F.col(source)).alias("source"))
    used = used.where(F.col("source").isin(*names) & F.col("text").isNotNull() & (F.length("text") > 0))
    one_in = max(1, used.count() // TRAIN_ROWS)
    sample = used.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).limit(2 * TRAIN_ROWS)
    held_out = F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(4)) == 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros((k, FEATURES + 1))
        for pdf in batches:
            for t, src in zip(pdf["text"], pdf["source"]):
                np.add.at(n[where[src]], _features(t), 1.0)
                n[where[src], FEATURES] += 1  # records
        i, f = np.nonzero(n)
        yield pd.DataFrame({"i": i, "f": f, "n": n[i, f]})

    counts = np.zeros((k, FEATURES + 1))
    # At most one row a source and feature.
    got = sample.where(~held_out).mapInPandas(count, "i int, f int, n double").groupBy("i", "f").agg(F.sum("n").alias("n")).toPandas()
    counts[got["i"], got["f"]] = got["n"]
    model = Classifier(*likelihoods(counts[:, :FEATURES], counts[:, FEATURES]), noise=label_noise)
    like = spark.sparkContext.broadcast(model.like)

    def scored(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([evidence(t, like.value) for t in pdf["text"]]) if len(pdf) else np.zeros((0, k)), pdf["source"].map(where).to_numpy(int)

    def rate_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s, label = scored(pdf)
            yield pd.DataFrame({"label": label, "s": list(s)})

    held = sample.where(held_out).mapInPandas(rate_labels, "label int, s array<double>").toPandas()
    model = model.calibrated(np.stack(held["s"].to_numpy()) if len(held) else np.zeros((0, k)), held["label"].to_numpy(int))
    judge = replace(model, like=np.zeros((0, 0)))  # the likelihoods are broadcast already
    if os.path.isfile(vocabulary):  # executors get it from the driver
        spark.sparkContext.addFile(vocabulary)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = SparkFiles.get(os.path.basename(vocabulary))
        path = sent if os.path.isfile(sent) else vocabulary
        for pdf in batches:
            s, label = scored(pdf)
            yield pd.DataFrame({"id": pdf["id"], "label": label, "tokens": [count_tokens(t, path) for t in pdf["text"]], "member": list(judge.membership(s, label))})

    # Texts end here; of several rows under an id one is kept.
    weighed = spread(used).mapInPandas(weigh, "id bigint, label int, tokens bigint, member array<double>")
    weighed = materialize(weighed.groupBy("id").agg(F.min(F.struct("label", "tokens", "member")).alias("w")).select("id", "w.*"), "mix")

    def summed(make) -> pd.DataFrame:
        """The sums of arrays that make(member, label, tokens, u) gives, element by element, over all records."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for pdf in batches:
                if len(pdf):
                    one = make(np.stack(pdf["member"].to_numpy()), pdf["label"].to_numpy(), pdf["tokens"].to_numpy(float), pdf["u"].to_numpy())
                    total = one if total is None else total + one
            if total is not None:
                at = np.flatnonzero(total)
                yield pd.DataFrame({"d": at, "t": total[at]})

        u = (F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
        return weighed.select("id", "label", "tokens", "member", u).mapInPandas(run, "d int, t double").groupBy("d").agg(F.sum("t").alias("t")).toPandas()

    def dense(df: pd.DataFrame, n: int) -> np.ndarray:
        out = np.zeros(n)
        out[df["d"].to_numpy(int)] = df["t"].to_numpy()
        return out

    def first(m, label, tokens, u):
        return np.concatenate([np.bincount(label, tokens, k), (cap[label] * tokens) @ m, ((m * tokens[:, None]).T @ m).ravel()])

    got = dense(summed(first), 2 * k + k * k)
    size, room, moments = got[:k], got[k : 2 * k], got[2 * k :].reshape(k, k)
    total = size.sum()
    room = np.where(size > 0, room, 0.0)  # what the records' caps allow each source, by membership
    # The mix's size: the largest at which every feasible source keeps its share within its cap.
    reach = np.divide(room, share, out=np.full(k, np.inf), where=share > 0)
    feasible = (share == 0) | (room > 0) & (reach >= least_size * total)
    bound = feasible & (share > 0)
    budget = reach[bound].min() if bound.any() else 0.0
    want = np.where(feasible, share * budget, np.minimum(room, share * budget) if budget else room)
    fixed = ~feasible  # used to their most

    def rate(x: np.ndarray, m: np.ndarray, label: np.ndarray) -> np.ndarray:
        return np.where(fixed[label], cap[label] * np.minimum(1.0, np.divide(want, room, out=np.zeros(k), where=room > 0))[label], np.clip(m @ x, 0.0, cap[label]))

    # Expected totals by membership; what infeasible sources give to others' totals is small and left to the passes below.
    aim = want.copy()
    x = np.minimum(np.divide(want, size, out=np.zeros(k), where=size > 0), cap).astype(float)
    for _ in range(PASSES if total else 0):
        x = fit(moments, aim, SLACK * cap, x)

        def reached(m, label, tokens, u, x=x):
            return (rate(x, m, label) * tokens) @ m

        lack = want - dense(summed(reached), k)
        if np.abs(lack).sum() <= 1e-3 * max(want.sum(), 1.0):
            break
        aim = np.maximum(aim + lack, 0.0)

    def rounding(m, label, tokens, u):
        """By source: the total by rates, the total of whole parts, and a histogram of tokens by how near a record is to one more."""
        r = rate(x, m, label)
        low = np.floor(r)
        open_ = low < cap[label]
        bin_ = np.clip(((u - (r - low) + 1) / 2 * BINS).astype(int), 0, BINS - 1)
        out = np.zeros((k, 2 + BINS))
        np.add.at(out[:, 0], label, r * tokens)
        np.add.at(out[:, 1], label, low * tokens)
        np.add.at(out, (label[open_], 2 + bin_[open_]), tokens[open_])
        return out.ravel()

    got = dense(summed(rounding), k * (2 + BINS)).reshape(k, 2 + BINS)
    ups = np.concatenate([np.zeros((k, 1)), np.cumsum(got[:, 2:], axis=1)], axis=1)
    edge = np.abs(ups - (got[:, :1] - got[:, 1:2])).argmin(axis=1)  # bins that are rounded up

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                m, label = np.stack(pdf["member"].to_numpy()), pdf["label"].to_numpy()
                r = rate(x, m, label)
                low = np.floor(r)
                bin_ = np.clip(((pdf["u"].to_numpy() - (r - low) + 1) / 2 * BINS).astype(int), 0, BINS - 1)
                n = np.minimum(low + (bin_ < edge[label]), cap[label]).astype(int)
                yield pd.DataFrame({"doc_id": pdf["id"], "label": label, "tokens": pdf["tokens"], "repeats": n, "member": pdf["member"]})

    u = (F.pmod(F.xxhash64("id", F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("u")
    drawn = weighed.select("id", "label", "tokens", "member", u).mapInPandas(draw, "doc_id bigint, label int, tokens bigint, repeats int, member array<double>").where("repeats > 0")
    listed = F.array(*[F.lit(n) for n in names]) if names else F.array(F.lit(""))
    of = F.element_at(listed, F.col("label") + 1).alias("source")
    chosen = drawn.select("doc_id", of, "tokens", "repeats")
    weight = F.col("tokens") * F.col("repeats")
    each = drawn.groupBy(of).agg(F.sum(weight).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("repeats").alias("uses"), F.array(*[F.sum(weight * F.col("member")[i]) for i in range(k)]).alias("m") if k else F.array().alias("m"))
    whole = each.agg(F.sum("tokens").alias("whole"), F.array(*[F.sum(F.col("m")[i]) for i in range(k)]).alias("by_member") if k else F.array().alias("by_member"))
    wanted = want / want.sum() if want.sum() else want
    goals = spark.createDataFrame(
        [(i, a, float(b), int(c), bool(d), float(e)) for i, (a, b, c, d, e) in enumerate(zip(names, goal["target_share"], cap, feasible, wanted))], "no int, source string, target_share double, max_repeats int, feasible boolean, wanted_share double"
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    part = lambda c, name: F.coalesce(c / F.col("whole"), F.lit(0.0)).alias(name)
    shares = goals.join(each.drop("m"), "source", "left").crossJoin(F.broadcast(whole)).select("source", "target_share", "max_repeats", "feasible", "wanted_share", part(F.col("tokens"), "reached_share"), part(F.get("by_member", F.col("no")), "member_share"), zero("tokens"), zero("documents"), zero("uses"))
    return chosen, shares
