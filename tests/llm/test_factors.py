"""Longest previous factors against all pairs of places, and the groups that repeated rows make."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtrack.llm import suffix_dedup
from tests.llm.test_model_operators import frame


@pytest.mark.parametrize("seed", range(60))
def test_longest_previous_factors(seed):
    r = np.random.default_rng(seed)
    k, least = int(r.integers(0, 8)), int(r.integers(1, 9))
    sizes = r.integers(0, 60, k)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    buf = r.integers(first := int(r.choice([0, 97])), first + int(r.integers(1, 4)), offs[-1]).astype(np.uint8)
    group, doc, start = np.sort(r.integers(0, 3, k)), r.integers(0, 3, k), r.integers(0, 20, k)
    s, factor = suffix_dedup.longest_previous_factors(group, doc, start, buf, offs, least)
    contexts = [buf[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    places = [(i, j) for i in range(k) for j in range(sizes[i] - least + 1)]
    want = {}
    for i, j in places:
        longest = 0
        for a, b in places:
            if group[a] == group[i] and (doc[a], start[a] + b) < (doc[i], start[i] + j):
                x, y = contexts[i][j:], contexts[a][b:]
                longest = max(longest, next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y))))
        want[offs[i] + j] = longest if longest >= least else 0
    got = dict(zip(s.tolist(), factor.tolist(), strict=True))
    assert got.keys() <= want.keys() and {k: got.get(k, 0) for k in want} == want


def test_long_runs_of_shared_bytes():
    """One letter throughout: all suffixes are one run, whose first place of each length has no factor."""
    n = 50
    offs, buf = np.arange(n + 1) * 168, np.full(n * 168, 97, np.uint8)
    r, _ = suffix_dedup.previous_factors(np.zeros(n, np.int64), np.arange(n)[::-1].copy(), np.zeros(n, np.int64), buf, offs)
    assert Counter(r.tolist()) == {i: 69 - (i == n - 1) for i in range(n)}


def test_repeated_rows_make_no_group(spark, monkeypatch):
    """Contexts of rows that repeat a text are read once a task, however many rows there are."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage = word(150)
    one, other = word(200) + passage + word(200), word(90) + passage + word(90)
    rows = [(1, one)] * 3000 + [(2, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    largest = []
    within = suffix_dedup._in_order

    def counted(contexts):
        largest.append(max([x["count"] for x in contexts.groupBy("g").count().collect()], default=0))
        return within(contexts)

    monkeypatch.setattr(suffix_dedup, "_in_order", counted)
    got = suffix_dedup.dedup(docs).groupBy("doc_id", "n_removed").agg(F.count("*").alias("n")).collect()
    assert {(x.doc_id, x.n) for x in got} == {(1, 3000), (2, 1)}
    assert {x.doc_id: x.n_removed > 140 for x in got} == {1: False, 2: True}
    assert 2 <= max(largest) <= 20
