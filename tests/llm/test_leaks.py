"""Decontamination finds every substitution that its rule tolerates, and nothing else."""

import random
from itertools import combinations

import pytest

from groundtrack.llm import decontaminate, source_mix
from tests.llm.test_pipeline import leaks


def tolerated(n, share=0.8):
    need = next(k for k in range(n + 1) if k >= share * n - 1e-9)
    return n - need


@pytest.mark.parametrize("n", range(1, 14))
@pytest.mark.parametrize("share", [0.8, 0.9, 0.5])
def test_some_mask_misses_every_change(n, share):
    """Each placement of the tolerated changes in a window of up to 13 words, by enumeration."""
    t = tolerated(n, share)
    whole = decontaminate.masks(n, t)
    shapes = decontaminate.sliding(whole)
    for gone in combinations(range(n), t):
        left = ["0" if i in gone else "1" for i in range(n)]
        assert any(all(left[i] == "1" for i, c in enumerate(m) if c == "1") for m in whole)
        assert any(all(left[k + i] == "1" for i, c in enumerate(m) if c == "1") for m in shapes for k in range(n - len(m) + 1))
    if (n, share) == (13, 0.8):
        assert shapes == ["111111", "111000111", "1110000001111"]


def test_every_tolerated_substitution_is_found(spark):
    """Items of 1 to 20 words, each placement of one change more than tolerated included (in a window of
    13 words of the longer ones): exactly what the rule says, by brute force."""
    items = {n: [f"i{n}w{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 20)}
    docs, want = [], set()
    for n, words in items.items():
        w = min(n, 13)
        for changes in (tolerated(w), tolerated(w) + 1):
            for gone in combinations(range(w), changes):
                text = ["left", *("other" if i in gone else x for i, x in enumerate(words[:w])), "right"]
                if leaks(" ".join(text), " ".join(words)):
                    want.add((len(docs), n))
                docs.append((len(docs), " ".join(text)))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()], "item_id long, text string")
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    assert sum(n == 13 for _, n in want) == 78 and sum(n == 10 for _, n in want) == 45 and sum(n == 9 for _, n in want) == 9


def test_random_substitutions_equal_brute_force(spark):
    """A fifth of the words of each planted passage changed at random: pairs equal brute force, none is lost."""
    r = random.Random(11)
    items = [" ".join(f"v{r.randrange(60)}" for _ in range(r.randrange(3, 45))) for _ in range(25)]
    texts = []
    for d in range(120):
        words = [f"v{r.randrange(60)}" for _ in range(r.randrange(0, 50))]
        copy = [w if r.random() > 0.2 else "changed" for w in r.choice(items).split()]
        texts.append(" ".join(words[:20] + (copy if d % 2 else []) + words[20:]))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bench).collect()}
    assert got == {(d, i) for d, t in enumerate(texts) for i, b in enumerate(items) if leaks(t, b)}


def test_mix_keeps_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "one two three", "s"), (1, "four five", "s"), (2, "six", "t"), (None, "seven", "t")], "doc_id long, text string, source string")
    got = source_mix.take(docs).collect()
    assert sorted(x.text for x in got if x.doc_id is None) == ["one two three", "seven"]
    assert all(x.mix_taken > 0 for x in got) and len(got) == 4
