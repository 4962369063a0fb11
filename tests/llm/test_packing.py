"""Packing: ids as the tokenizer gives them, sequences without gaps, plans near or at the optimum."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundtrack.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def odd_texts(r):
    alphabet = ["a", "B", "s", "'s", "'", "'T", "|", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", ".", "!?", "1", "23", "é", "é", "́", "日本", "ß", "ΑΣ", "💬", " ", " ", "\x1c", "\x00", "-", "_", " ", " ", "\n", "\t", "''re"]
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(0, 60))) for _ in range(400)] + [None, "", " ", "word " * 3000, "x" * 5000, "...", None]


@pytest.mark.parametrize("region, kept", [(1 << 20, 1 << 18), (300, 64), (7, 1 << 18)])
def test_ids_are_those_of_whole_texts(monkeypatch, region, kept):
    monkeypatch.setattr(packing, "REGION", region)
    monkeypatch.setattr(packing, "KEPT", kept)
    texts = odd_texts(random.Random(region))
    got = list(packing.Tokens(PATH).texts(pa.array(texts)))
    want = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [g.tolist() for g in got] == [w.ids for w in want]


def checked(runs, counts, capacity):
    seen = np.zeros(capacity + 1, np.int64)
    for run in runs:
        assert run.count > 0 and run.left >= 0 and run.left + sum(a * b for a, b in run.held) == capacity
        for length, n in run.held:
            seen[length] += n * run.count
    assert np.array_equal(seen, counts)
    return sum(r.count for r in runs)


def test_plans_hold_every_piece_in_few_sequences():
    r = np.random.default_rng(5)
    for capacity, lengths in ((100, r.integers(1, 101, 3000)), (2048, r.integers(600, 1100, 5000)), (64, r.integers(20, 40, 40)), (2048, np.full(9, 2048)), (10, np.ones(25, int)), (1, np.ones(3, int))):
        counts = np.bincount(lengths, minlength=capacity + 1)
        n = checked(packing.plan(counts, capacity), counts, capacity)
        assert n <= checked(packing.best_fit([], counts.copy(), capacity), counts, capacity)
    assert packing.plan(np.zeros(11, np.int64), 10) == []


def test_configurations_beat_best_fit_where_greed_fails():
    """Lengths just over 1/2, over and under 1/4 (copied 50 times): nine sequences hold what best fit puts into eleven."""
    counts = np.zeros(1001, np.int64)
    for length, n in ((501, 6), (252, 6), (251, 6), (248, 12)):
        counts[length] = 50 * n
    assert checked(packing.best_fit([], counts.copy(), 1000), counts, 1000) == 550
    assert checked(packing.plan(counts, 1000, ((96, 1 / 5),)), counts, 1000) <= 455


@pytest.mark.parametrize("groups", [3, 8, 100])
def test_groups_have_equally_many_pieces(groups):
    r = np.random.default_rng(groups)
    counts = np.bincount(r.integers(30, 90, 700), minlength=101)
    lengths = np.flatnonzero(counts)[::-1]
    got = packing.grouped(lengths, counts[lengths], groups)
    assert [x for g in got for x, n in g for _ in range(n)] == sorted(np.repeat(lengths, counts[lengths]), reverse=True)
    if groups == 3:
        assert {sum(n for _, n in g) for g in got} <= {233, 234}


@pytest.mark.parametrize("capacity", [32, 2048])
def test_every_piece_has_its_place(spark, capacity):
    r = random.Random(8)
    texts = odd_texts(r)
    docs = [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (7, "other")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    rows = packing.packed(df, PATH, capacity, ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((i, p, at, len(part) // 4, zlib.crc32(part)))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted((tuple(x)[:5] for x in rows), key=key) == sorted(want, key=key)
    by = defaultdict(list)
    for x in rows:
        by[x.sequence_id].append((x.offset, x.length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(x.length for x in rows)
    assert len(by) <= 1.05 * total / capacity + 2
    whole = {x.sequence_id: x.ids for x in packing.sequences(packing.packed(df, PATH, capacity, ids=True)).collect()}
    assert sum(map(len, whole.values())) == 4 * total and max(map(len, whole.values())) <= 4 * capacity
