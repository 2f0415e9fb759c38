import os

import pytest

from lodestone.llm import mixing
from tests.conftest import rows

pytestmark = pytest.mark.skipif(not os.path.isfile(mixing.VOCABULARY), reason="no vocabulary here")
TOPICS = {"alpha": "river boat harbor anchor sail tide", "beta": "kernel thread stack queue mutex", "gamma": "flour sugar butter oven dough"}


def docs(spark, counts):
    out, n = [], 0
    for topic, k in counts.items():
        words = TOPICS[topic].split()
        for i in range(k):
            n += 1
            out.append((n, " ".join(words[(i + j) % len(words)] for j in range(20 + i % 30)), f" {topic.upper()} " if i % 7 == 0 else topic, "x"))
    out += [(9001, None, "alpha", "x"), (9002, "", "beta", "x"), (9003, "some text", "unlisted", "x"), (9004, "some text", None, "x"), out[0]]
    return spark.createDataFrame(out, "doc_id bigint, text string, source string, label string")


def targets(spark, rows_):
    return spark.createDataFrame(rows_, "source string, target_share double, max_repeats int")


def test_reaches_targets(spark):
    t = targets(spark, [("Alpha", 0.5, 2), ("beta ", 0.3, 2), ("gamma", 0.2, 1)])
    chosen, shares = mixing.mix(docs(spark, {"alpha": 400, "beta": 500, "gamma": 300}), t)
    got = {r["source"]: r for r in shares.collect()}
    assert {k: got[k]["reached_share"] for k in got} == pytest.approx({"alpha": 0.5, "beta": 0.3, "gamma": 0.2}, abs=0.005)
    assert all(r["feasible"] and abs(r["member_share"] - r["reached_share"]) < 0.01 for r in got.values())
    c = chosen.collect()
    assert max(r["repeats"] for r in c) <= 2 and max(r["repeats"] for r in c if r["source"] == "gamma") == 1
    assert len({r["doc_id"] for r in c}) == len(c) and not {9001, 9002, 9003, 9004} & {r["doc_id"] for r in c}
    assert sum(r["tokens"] * r["repeats"] for r in c if r["source"] == "alpha") == got["alpha"]["tokens"]


def test_small_and_absent_sources(spark):
    t = targets(spark, [("alpha", 0.4, 1), ("beta", 0.3, 3), ("gamma", 0.2, 2), ("delta", 0.1, 5)])
    chosen, shares = mixing.mix(docs(spark, {"alpha": 500, "beta": 400, "gamma": 4}), t)
    got = {r["source"]: r for r in shares.collect()}
    assert got["delta"]["uses"] == 0 and got["gamma"]["uses"] == 8
    assert got["alpha"]["reached_share"] / got["beta"]["reached_share"] == pytest.approx(4 / 3, abs=0.02)
    assert {k: r["feasible"] for k, r in got.items()} == {"alpha": True, "beta": True, "gamma": False, "delta": False}
    # Without the least size the small source keeps its share, and the mix is as small as that takes.
    shares = {r["source"]: r for r in mixing.mix(docs(spark, {"alpha": 500, "beta": 400, "gamma": 4}), t, least_size=0.0)[1].collect()}
    assert shares["gamma"]["feasible"] and shares["gamma"]["reached_share"] == pytest.approx(2 / 9, abs=0.03) and shares["alpha"]["uses"] < 30


def test_empty(spark):
    t = targets(spark, [("alpha", 1.0, 2)])
    chosen, shares = mixing.mix(docs(spark, {"alpha": 1}).limit(0), t)
    assert chosen.count() == 0 and rows(shares, "reached_share", "uses") == [(0.0, 0)]


def trained(data):
    import numpy as np

    names = list(TOPICS)
    counts, n = np.zeros((3, mixing.FEATURES)), np.zeros(3)
    for t, src in data:
        np.add.at(counts[names.index(src)], mixing._features(t), 1.0)
        n[names.index(src)] += 1
    return mixing.likelihoods(counts, n)


def test_membership_is_soft():
    import numpy as np

    c = mixing.Classifier(*trained([(w, k) for k, w in TOPICS.items() for _ in range(5)]))
    found = np.stack([mixing.evidence(t, c.like) for t in ("kernel thread mutex queue stack kernel", "")])
    p = c.membership(found, np.array([0, 0]))
    assert p.sum(axis=1) == pytest.approx([1, 1]) and p[0, 1] > p[0, 2] and p[1, 0] > 0.9


def test_classifier_on_held_out_records():
    import random

    import numpy as np

    rnd = random.Random(2)
    names = list(TOPICS)
    make = lambda k: " ".join(rnd.choice(TOPICS[k].split() + "the a of and to".split()) for _ in range(15))
    data = [(make(k), k) for _ in range(160) for k in names]
    c = mixing.Classifier(*trained(data[:120]))
    found = np.stack([mixing.evidence(t, c.like) for t, _ in data[120:]])
    label = np.array([names.index(k) for _, k in data[120:]])
    assert ((c.prior + found).argmax(axis=1) == label).mean() >= 0.95
    # The less the labels agree with the texts, the less sure the texts are taken to be.
    wrong = np.where(np.arange(len(label)) % 4 == 0, (label + 1) % 3, label)
    assert c.calibrated(found, wrong).scale < c.calibrated(found, label).scale


def test_fit_stays_within_its_bounds():
    import numpy as np

    m = np.array([[100.0, 5.0, 0.0], [5.0, 60.0, 2.0], [0.0, 2.0, 30.0]])
    x = mixing.fit(m, m @ np.array([0.5, 1.5, 0.2]), np.array([2.0, 2.0, 1.0]), np.zeros(3))
    assert x == pytest.approx([0.5, 1.5, 0.2], abs=1e-4)
    assert (mixing.fit(m, np.array([1e4, 60.0, -5.0]), np.array([2.0, 2.0, 1.0]), np.ones(3)) <= [2, 2, 1]).all()


def test_long_texts_are_counted_whole():
    text = "ab cd\n" * 60_000 + "x" * 150_000
    assert mixing.count_tokens(text) == len(mixing._encoder(mixing.VOCABULARY).encode_ordinary(text))


def test_tokens():
    assert mixing.count_tokens("hello world") == 2 and mixing.count_tokens("") == 0 and mixing.count_tokens("ab " * 100_000) > 1000
