"""Phrases against plain counts, over seams and shards, and sketches that never underestimate."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from groundtrack.llm import common, phrases
from groundtrack.llm.common import utf8


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, longest=4, least=30, best=2000, share=80):
    """rows: (lang, text). Each lang's ranked phrases, as the contract words them."""
    counts, total = {}, Counter()
    for lang, text in rows:
        f = counts.setdefault(lang or "und" if lang != "" else "", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang if lang is not None else "und"] += len(w)
            for k in range(1, longest + 1):
                f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[p[:c]] + f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(rows)[:best], 1):
            out.append((lang, rank, p.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def prose(r, n):
    words = ["New", "new", "york", "times", "the", "of", "é", "x-y", "日本", "a'b", *[f"w{i}" for i in range(40)]]
    out = []
    for _ in range(n):
        out.append(r.choice(["new york times", "the New York", r.choice(words), r.choice(words), "of the\tnew  day"]))
        out.append(r.choice([" "] * 12 + [". ", ", ", "\n", "!", "\t ", "  "]))
    return "".join(out)


@pytest.mark.parametrize("seed, best", [(1, 2000), (2, 15)])
def test_equals_plain_counts(spark, monkeypatch, seed, best):
    monkeypatch.setattr(phrases, "RANKED", 20)  # so that parts of a lang are ranked apart
    r = random.Random(seed)
    rows = [(r.choice(["en", "en", "en", "de", None, "und", ""]), prose(r, r.randrange(1, 120))) for _ in range(200)]
    rows += [("en", None), (None, None), ("xx", "rare words"), ("en", ""), ("en", " . "), ("en", rows[0][1])]
    got = phrases.collocations(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(5), best=best)
    assert sorted(map(tuple, got.collect())) == brute(rows, best=best)
    assert got.count() > 20


@pytest.mark.parametrize("longest, least", [(2, 3), (3, 400)])
def test_other_lengths_and_frequencies(spark, longest, least):
    r = random.Random(9)
    rows = [("en", prose(r, 60)) for _ in range(60)]
    got = phrases.collocations(spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string"), longest=longest, least=least)
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least)


def test_regions_have_no_seam(monkeypatch):
    """Texts longer than a region, words longer than a block, phrases across edges: the same phrases."""
    r = random.Random(4)
    texts = [prose(r, 900), None, "", "x" * 3000 + " " + "y" * 700, "end", prose(r, 5), "a b c d e f"]

    def found():
        import pyarrow as pa

        buf, offs = utf8(pa.array(texts))
        out = Counter()
        for g in phrases.Grams(buf, offs, np.arange(len(texts)).astype(np.uint64), 4):
            for k, at in enumerate(g.runs, 1):
                for t, i, key in zip(g.texts(at, np.full(len(at), k)).to_pylist(), at, g.keys[k - 1][at], strict=True):
                    out[int(g.doc[i]), k, t, int(key)] += 1
        return out

    whole = found()
    plain = Counter()
    for d, t in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            plain.update((d, k, " ".join(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    assert Counter({(d, k, t): n for (d, k, t, _), n in whole.items()}) == plain
    for region, block in ((64, 16), (500, 128), (37, 1 << 20)):
        monkeypatch.setattr(phrases, "REGION", region)
        monkeypatch.setattr(common, "SLICE_BYTES", block)
        assert found() == whole


def test_a_narrow_sketch_loses_nothing(spark, monkeypatch):
    """With many more phrases than cells, rare ones pass the sketch and go in the exact counts."""
    r = random.Random(6)
    rows = [("en", prose(r, 100) + " " + " ".join(f"u{r.random()}" for _ in range(300))) for _ in range(120)]
    df = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string").repartition(3)
    monkeypatch.setattr(phrases, "CELLS", 1 << 12)
    monkeypatch.setattr(phrases, "CHUNK", 1 << 8)
    assert sorted(map(tuple, phrases.collocations(df).collect())) == brute(rows)
