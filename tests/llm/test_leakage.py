import random

import pytest

from lodestone.llm import leakage as k
from tests.conftest import rows

WORDS = [f"w{i}" for i in range(200)] + ["a", "I", "é", "3"]


def brute(docs, items, n=13):
    grams = {}
    for i, t in items:
        w = k.words_of(t or "")
        for j in range(len(w) - n + 1):
            grams.setdefault(tuple(w[j : j + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = k.words_of(t or "")
        for j in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[j : j + n]), ())}
    return out


def test_against_brute_force(spark, monkeypatch):
    rnd = random.Random(4)
    items = [(i, " ".join(rnd.choice(WORDS) for _ in range(rnd.choice([5, 13, 40, 80])))) for i in range(30)] + [(30, "a " * 20), (31, "a b c d e f g h i j k l m"), (32, "")]
    docs = []
    for d in range(200):
        w = [rnd.choice(WORDS) for _ in range(rnd.randrange(60))]
        own = k.words_of(rnd.choice(items)[1])
        n = rnd.randrange(8, 20)
        at = rnd.randrange(max(1, len(own) - n + 1))
        w[len(w) // 2 : len(w) // 2] = own[at : at + n]
        docs.append((d, rnd.choice([" ", "\n", " -- ", "_"]).join(x.upper() if rnd.random() < 0.3 else x for x in w)))
    docs += [(200, None), (201, ""), (202, "A, B! c\nd e f (g) h i j k l m"), (203, "a b c d e f g h i j k l n")]
    D = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string")
    I = spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    got = set(rows(k.find_leaks(D, I), "doc_id", "item_id"))
    want = brute(docs, items)
    # Too many items to be broadcast are joined; very frequent q-grams are worked off in parts.
    assert set(rows(k.find_leaks(D, I, sent_chars=0), "doc_id", "item_id")) == want
    index = k.ItemIndex.build(items, 12)
    norm = [" ".join(k.words_of(t or "")) for _, t in docs]
    regions = k.find_regions(norm, index, 25, 0, 13)
    monkeypatch.setattr(k, "HELD", 40)
    assert [r[:6] for r in k.find_regions(norm, index, 25, 0, 13)] == [r[:6] for r in regions]
    assert got == want and (202, 31) in got and (203, 31) not in got and len(want) > 40
    assert k.find_leaks(D.limit(0), I).count() == 0 and k.find_leaks(D, I.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(10)]
    D = spark.createDataFrame([(i, "start " + t) for i, t in items], "doc_id bigint, text string")
    I = spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    monkeypatch.setattr(k, "BLOCK_CHARS", 300)
    assert rows(k.find_leaks(D, I), "doc_id", "item_id") == [(i, i) for i in range(10)]


def test_whole_words():
    a, b = "xfoo bar baz quy", "foo bar baz quz"
    assert k.whole_words(a, 1, 15, b, 0) == (5, 12) and a[5:12] == "bar baz"
    assert k.whole_words("foo bar", 0, 7, "a foo bar c", 2) == (0, 7) and k.whole_words("afoo", 1, 4, "foo", 0)[0] >= k.whole_words("afoo", 1, 4, "foo", 0)[1]


def test_edits_over_joined_items(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(3, 9)))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(40)]
    docs = []
    for d in range(60):  # labelled: the passage of item d % 40 with d % 4 letters changed in each 100
        own = items[d % 40][1]
        out = list(own[:100].rsplit(" ", 1)[0] + own[len(own[:100].rsplit(" ", 1)[0]) : 200].rsplit(" ", 1)[0])
        for n in range(d % 4 * (len(out) // 100)):
            at = next(x for x in rnd.sample(range(10, len(out) - 10), len(out) - 20) if out[x] != " ")
            out[at] = "z"
        docs.append((d, " ".join(word() for _ in range(10)) + " " + "".join(out) + " " + word()))
    D = spark.createDataFrame(docs, "doc_id bigint, text string")
    I = spark.createDataFrame(items, "item_id bigint, text string")  # noqa: E741
    got = set(rows(k.find_leaks(D, I, edits=5, q=12, min_chars=100), "doc_id", "item_id"))
    assert got == {(d, d % 40) for d in range(60)} and got == set(rows(k.find_leaks(D, I, edits=5, q=12, min_chars=100, sent_chars=0), "doc_id", "item_id"))


def test_edits(spark):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of uncommon strength near the old stone bridge at dawn"
    near = item.replace("lazy", "lasy").replace("potion", "potions")
    far = " ".join(w[::-1] for w in item.split())
    D = spark.createDataFrame([(1, "x " + near + " y"), (2, far)], "doc_id bigint, text string")
    I = spark.createDataFrame([(1, item)], "item_id bigint, text string")  # noqa: E741
    got = k.find_leaks(D, I, edits=5, q=12, min_chars=100).collect()
    assert [(r["doc_id"], r["distance"]) for r in got] == [(1, 2)]
    with pytest.raises(ValueError):
        k.find_leaks(D, I, edits=50, q=12, min_chars=100)


def test_a_passage_within_a_longer_region_that_fails(spark):
    rnd = random.Random(9)
    w = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(60)]
    item = " ".join(w[:45])
    own = [x if n % 6 else x[:-1] + "z" for n, x in enumerate(w[1:17], 1)]  # 111 characters, two edits, no run of 13 words
    other = ["".join(rnd.choice("qrstuvwxyz") for _ in range(6)) for _ in range(14)]
    docs = [(1, " ".join([*own, *other, *w[31:34]])), (2, " ".join([*w[1:4], *other, *own])), (3, " ".join([*w[1:4], *other, *w[18:21], *other, *w[35:38]]))]
    docs += [(4, " ".join([w[1], *(x[:-1] + "z" if n in (1, 3) else x for n, x in enumerate(w[2:15])), w[15]]))]  # its shared q-grams alone span less than 100
    D = spark.createDataFrame(docs, "doc_id bigint, text string")
    I = spark.createDataFrame([(1, item)], "item_id bigint, text string")  # noqa: E741
    got = {r["doc_id"]: r for r in k.find_leaks(D, I, edits=5, q=12, min_chars=100).collect()}
    assert {1, 4} <= set(got) and 3 not in got and got[1]["distance"] == 2 and " ".join(own) in got[1]["passage"] and got[1]["words"] < 13


@pytest.mark.parametrize("seed", range(4))
def test_parts_against_brute_force(seed):
    rnd = random.Random(seed)
    w = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) for _ in range(70)]
    item = " ".join(w)
    docs = []
    for _ in range(12):
        own = list(w)
        for _ in range(rnd.randrange(4, 16)):
            n = rnd.randrange(len(own))
            own[n] = own[n][:-1] + "z"
        docs.append(" ".join(own))
    index = k.ItemIndex.build([(7, item)], 12)
    got = {x[0] for x in k.find_parts(docs, index, k.find_regions(docs, index, 100, 5), 100, 5)}
    want = set()
    ends = [m.end() for m in k.re.finditer(r"[^ ]+", item)]
    for d, text in enumerate(docs):  # all edits are substitutions
        for m in k.re.finditer(r"[^ ]+", text):
            for e in ends:
                s = m.start()
                if 100 <= e - s and sum(x != y for x, y in zip(text[s:e], item[s:e])) <= 5 and item[s : m.end()] == m.group(0) and text[:e].split()[-1] == item[:e].split()[-1]:
                    want.add(d)
    assert want <= got


def test_banded_distance():
    def full(a, b):
        r = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            n = [i]
            for j, y in enumerate(b, 1):
                n.append(min(r[j] + 1, n[-1] + 1, r[j - 1] + (x != y)))
            r = n
        return r[-1]

    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("ab ") for _ in range(rnd.randrange(14))) for _ in range(2))
        limit = rnd.randrange(8)
        assert k.banded_distance(a, b, limit) == min(full(a, b), limit + 1)
