"""Brute-force checks and edge cases of the operators on texts that meet by hash."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from groundtrack.llm import decontaminate, jaccard_join, language_id, line_dedup, source_mix
from groundtrack.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, extra string"


def frame(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source if isinstance(source, str) else source[i], "x") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed, n, words=60, vocabulary=400):
    r = random.Random(seed)
    texts = [" ".join(f"w{r.randrange(vocabulary)}" for _ in range(r.randrange(1, words))) for _ in range(n)]
    for i in range(n // 2):
        base = r.choice(texts).split(" ")
        for _ in range(r.randrange(0, 3)):
            base[r.randrange(len(base))] = f"w{r.randrange(vocabulary)}"
        texts.append(" ".join(base))
    return texts + [None, "", "   ", "A b", "a  B", "one two three", "x" * 200_000, " ".join(["long"] * 5000), texts[0], texts[0]]


def brute_components(texts, k, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), links[i]) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("k", "num", "block"), [(3, 90, 1 << 20), (5, 80, 1 << 20), (2, 60, 300)])
def test_jaccard_components(spark, monkeypatch, k, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    texts = corpus(k, 120)
    got = jaccard_join.jaccard_components(frame(spark, texts), k, num, 100).collect()
    assert sorted(map(tuple, got)) == brute_components(texts, k, num, 100)


def test_jaccard_with_common_shingles_and_small_ranges(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE", 700)
    monkeypatch.setattr(jaccard_join, "OFTEN", 3)
    monkeypatch.setattr(jaccard_join, "OFTEN_SLICES", 0)
    texts = corpus(9, 120)
    texts = [t + " " + " ".join(f"foot{j}" for j in range(30)) if t and i % 2 else t for i, t in enumerate(texts)]
    for k, num in ((3, 90), (5, 80)):
        got = jaccard_join.jaccard_components(frame(spark, texts), k, num, 100).collect()
        assert sorted(map(tuple, got)) == brute_components(texts, k, num, 100)


@pytest.mark.parametrize(("num", "least"), [(90, 5), (80, 5), (90, 0), (80, 0), (60, 0), (40, 0)])
def test_jaccard_linked_sets_share_a_first_piece(monkeypatch, num, least):
    monkeypatch.setattr(jaccard_join, "LEAST_LEVEL", least)
    r, links = np.random.default_rng(num), 0
    for _ in range(1500):
        a = np.unique(r.integers(0, 1 << 64, r.integers(1, 120), dtype=np.uint64))
        kept = a[r.random(len(a)) > r.choice([0, 0.03, 0.1, 0.2])]
        b = np.unique(np.concatenate([kept, r.integers(0, 1 << 64, r.integers(0, 2 + len(a) // 6), dtype=np.uint64)]))
        both, either = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if both == either or 100 * both < num * either or not both:
            continue
        links += 1
        p, offs, row, first, _ = jaccard_join._pieces(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, 100)
        parts = [(row[i], p[offs[i] : offs[i + 1]].tolist(), first[i]) for i in range(len(row))]
        shared = set.intersection(*({x for w, own, _ in parts if w == side for x in own} for side in (0, 1)))
        for order in (lambda x: x, lambda x: -x, lambda x: (x in shared, x)):  # the last one is the worst
            begin = [{x for w, own, n in parts if w == side for x in sorted(own, key=order)[:n]} for side in (0, 1)]
            assert begin[0] & begin[1]
    assert links > 200


def test_jaccard_deals_less_than_its_shingles():
    r = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.2, 700) % 3000) for _ in range(400)]
    batch = pa.record_batch({"text": pa.array(texts)})
    dealt = pd.concat(x.to_pandas() for x in jaccard_join._deal(3, 90, 100, np.zeros(0, np.uint64), 4)(iter([batch])))
    entries = sum(len(x) for x in dealt.low) // 4
    total = sum(len(set(zip(w, w[1:], w[2:], strict=False))) for w in (t.split() for t in texts))
    assert entries < 0.5 * total
    passed = pd.concat(jaccard_join._count(4)(rows) for _, rows in dealt.groupby("part"))
    assert sum(len(x) for x in passed.low) // 4 < 0.05 * total


def test_jaccard_query_keeps_rows_without_id(spark, tmp_path):
    rows = [(None, "a b c d", "en", "s", "x"), (None, None, "en", "s", "x"), (3, "a b c d", "en", "s", "x")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in jaccard_join.query(spark, str(tmp_path)).collect()}
    assert got == {(None, 2, None, 0), (None, 0, None, 0), (3, 2, 3, 0)}


def test_jaccard_empty_and_null_ids(spark):
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", None, None, None), (7, None, None, None, None)], SCHEMA)
    assert [tuple(r) for r in jaccard_join.jaccard_components(df).collect()] == [(7, 0, 7, 0)]


def brute_lines(texts, least=5, near=8):
    def within(a, b):
        if a == b:
            return True
        m = min(len(a), len(b))
        if m < near or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = (a, b) if len(a) > len(b) else (b, a)
        return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))

    seen, gone = [], {}
    for d, t in enumerate(texts):
        for k, line in enumerate((t or "").split("\n")):
            w = re.findall(r"[^\x20\x09-\x0D]+", line.lower())
            if len(w) >= least:
                if any(within(w, x) for x in seen):
                    gone.setdefault(d, []).append(k)
                seen.append(w)
    return gone


def test_line_dedup(spark):
    r = random.Random(5)
    pool = [[f"w{r.randrange(50)}" for _ in range(r.randrange(3, 15))] for _ in range(60)]
    texts = []
    for _ in range(80):
        lines = []
        for _ in range(r.randrange(0, 6)):
            w = list(r.choice(pool))
            what = r.randrange(5)
            if what == 1:
                w[r.randrange(len(w))] = "new"
            elif what == 2:
                w.insert(r.randrange(len(w) + 1), "more")
            elif what == 3:
                del w[r.randrange(len(w))]
            lines.append(" ".join(w))
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", "A b c d e\r\nA B  c d e", " ".join(["same"] * 30_000), " ".join(["same"] * 30_000)]
    docs = frame(spark, texts)
    want = brute_lines(texts)
    got = {row.doc_id: row.lines for row in line_dedup.repeated_lines(docs).collect()}
    assert got == want
    kept = {row.doc_id: (row.text, row.extra) for row in line_dedup.dedup(docs).collect()}
    for d, t in enumerate(texts):
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(d, []))
        assert kept[d] == (left, "x")
    assert line_dedup.dedup(frame(spark, [])).count() == 0


def test_short_lines_go_too(spark, tmp_path):
    r = random.Random(11)
    pool = [[f"w{r.randrange(12)}" for _ in range(r.randrange(1, 9))] for _ in range(90)]
    texts = ["\n".join(" ".join(r.choice(pool)) for _ in range(r.randrange(1, 6))) for _ in range(60)]
    texts += ["All rights reserved.\n\nnew", "ALL  rights reserved.\n\nNew\r", "in erre to it therble whrehe at.", "in erre to it rendon whrehe at.", "one two three four", "one two three five"]
    want = brute_lines(texts, 1, 5)
    assert want[61] == [0, 2] and want[63] == [0] and 65 not in want
    docs = frame(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {row.doc_id: row.removed for row in line_dedup.query(spark, str(tmp_path)).collect() if row.n_removed}
    assert got == {d: ",".join(map(str, lines)) for d, lines in want.items()}


def repeated_ids(spark, texts):
    """Rows whose doc_id repeats with other texts, and the place that each row counts at."""
    rows = [(i // 2, t, "en", "s", "x") for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", "x"), (0, None, "en", "s", "x"), (0, "", "en", "s", "x")]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_lines_of_repeated_ids(spark):
    r = random.Random(6)
    pool = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(5, 12))) for _ in range(40)]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.6 else r.choice(pool) + " more" for _ in range(r.randrange(1, 5))) for _ in range(60)]
    texts += ["only here in this one line\nand " + pool[0], pool[0] + "\nanother line that is nowhere else"]
    rows, docs = repeated_ids(spark, texts)
    lines = [(d, k, re.findall(r"[^\x20\x09-\x0D]+", x.lower())) for d, t, *_ in rows if d is not None and t for k, x in enumerate(t.split("\n"))]

    def earlier(d, k, w):
        return any((a, b) < (d, k) and brute_lines([" ".join(u), " ".join(w)]) for a, b, u in lines)

    want = []
    for d, t, *_ in rows:
        kept = None if t is None else [x for k, x in enumerate(t.split("\n")) if d is None or not earlier(d, k, re.findall(r"[^\x20\x09-\x0D]+", x.lower()))]
        want.append((d, None if kept is None else "\n".join(kept)))
    got = [(x.doc_id, x.text) for x in line_dedup.dedup(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
    assert sorted(got, key=key) == sorted(want, key=key)


def test_decontaminate(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"v{r.randrange(3000)}"
    items = [[word() for _ in range(r.randrange(8, 40))] for _ in range(30)]
    texts, leaks = [], set()
    for d in range(60):
        w = [word() for _ in range(r.randrange(0, 80))]
        if d % 3 == 0:
            i = r.randrange(len(items))
            copy = list(items[i])
            if len(copy) >= 20:
                copy[10] = "changed"
                copy[15] = "CHANGED"
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in copy]
            leaks.add((d, i))
        texts.append(" ".join(w))
    texts += [None, ""]
    bench = spark.createDataFrame([*((i, " ".join(w), "c") for i, w in enumerate(items)), (None, texts[0], "c"), (99, None, "c"), (98, "few words", "c")], "item_id long, text string, doc_id string")
    docs = frame(spark, texts)
    for words in (1 << 18, 200):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", words)
        got = decontaminate.find(docs, bench).collect()
        assert {(x.doc_id, x.item_id) for x in got} == leaks
        assert all(x.matched >= 0.8 * x.item_words for x in got)
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns
        assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {d for d, _ in leaks}
    assert decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_short_items_and_bounded_hits(spark, monkeypatch):
    phrase = "the same eight words of a common phrase"
    items = [(i, f"{phrase} number{i} item{i}") for i in range(40)] + [(90, "Lone word-pair"), (91, "seven words are all of this item"), (92, "")]
    texts = [f"x {phrase} y " * 5, "a lone WORD pair, here", "lone pair", "seven words are all of this", "so: seven words are all of this item!", None, phrase + " number3 item3"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = None
    for hits in (1 << 17, 7):
        monkeypatch.setattr(decontaminate, "HITS", hits)
        again = sorted(map(tuple, decontaminate.find(frame(spark, texts), bench).collect()))
        assert got is None or again == got
        got = again
    # eight of ten words are 80 % of an item, so each item of the phrase is found where it stands
    assert {(d, i) for d, i, *_ in got} == {(d, i) for d in (0, 6) for i in range(40)} | {(1, 90), (4, 91)}


def test_shared_folder_is_asked_for_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)


def test_source_mix(spark):
    r = random.Random(8)
    texts = [" ".join(["w"] * r.randrange(0, 900)) for _ in range(400)] + [None, "", "word " * 20_000]
    source = [r.choice(["a", "a", "a", "b", None, "z", "é"]) for _ in texts]
    docs = frame(spark, texts, source=source)
    rows = source_mix.mixed(docs).collect()
    assert len(rows) == len(texts)
    total, by = Counter(), {}
    for x in rows:
        assert x.size == len((texts[x.doc_id] or "").split()) and 0 <= x.taken <= 2 * x.size
        total[x.source] += x.size
        by.setdefault(x.source, []).append(x)
    names = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in over or free:
            target[s] = 2.0 * total[s] if over else level * weight[s]
        left -= sum(2.0 * total[s] for s in over)
        free -= over or free
    for s, own in by.items():
        assert {x.source_size for x in own} == {total[s]}
        assert abs(own[0].target - target[s]) < 1e-6 * max(1, target[s])
        assert sum(x.taken for x in own) == int(target[s] + 1e-9)
    again = source_mix.mixed(docs.repartition(7)).collect()
    assert sorted((x.doc_id, x.taken) for x in again) == sorted((x.doc_id, x.taken) for x in rows)
    assert source_mix.mixed(docs.limit(0)).count() == 0


def test_schedule_is_even(spark):
    docs = frame(spark, ["w " * 6400] * 4, source=["a", "b", "c", "c"])
    table = source_mix.targets(source_mix.sizes(docs))
    need = {r.place: r.need for r in table.collect()}
    got = Counter(r.place for r in source_mix.schedule(table).collect())
    assert got == {k: v for k, v in need.items() if v}


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows)
    odd = frame(spark, [None, "", "123 !!", "a", "the " * 100_000])
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[0].score == 0
    assert got[4].lang_pred == "en" and 0 <= got[4].score <= 1
    assert language_id.keep(odd, model).columns == odd.columns
    assert language_id.predict(odd.limit(0), model).count() == 0
    assert language_id.train(odd.limit(0)) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_long_texts_are_counted_without_a_seam(monkeypatch):
    r = random.Random(1)
    texts = ["".join(r.choice("abc dé1. ,  \nΣX") for _ in range(r.randrange(400))) for _ in range(60)] + [""]
    want = language_id.features(texts)
    for piece in (1, 2, 3, 50):
        monkeypatch.setattr(language_id, "PIECE", piece)
        got = language_id.features(texts)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_language_machines_are_whole_and_make_no_copy():
    assert language_id.SAMPLE >= 2400
    x, has = language_id.features(["A text of some words", "", "1 2 3"])
    assert x.shape[1] >= 8192 and x.dtype == np.float32 and list(has) == [True, False, False]
    r = np.random.default_rng(4)
    x = np.abs(r.normal(size=(300, 4000))).astype(np.float32)
    y = np.where(np.arange(300) % 2, 1.0, -1.0)
    x[y > 0, :40] += 1.0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    w = language_id.fit_svm(x, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes / 4 and len(w) == 4001
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) == 1.0
