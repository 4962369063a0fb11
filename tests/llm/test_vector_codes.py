"""Vector codes against Lloyd's rounds in plain Python, and Hamerly's bounds."""

import hashlib
import random

import numpy as np
import pytest

from groundtrack.llm import vector_codes as vc


def brute(vectors, parts=16, entries=64, rounds=2):
    """vectors: (vec_id, label, whole numbers) in order of vec_id."""
    width = len(vectors[0][2]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for _, _, v in vectors]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda: [[min(range(len(books[p])), key=lambda e: (gap(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = near()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, code in zip(cut, codes, strict=True) if code[p] == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    codes = near()
    errors = [sum(gap(c[p], books[p][code[p]]) for p in range(parts)) for c, code in zip(cut, codes, strict=True)]
    text = ",".join(str(x) for p in range(parts) for e in books[p] for x in e)
    return ["".join(f"{e:02x}" for e in code) for code in codes], errors, hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed, spread, n", [(1, 1.0, 150), (2, 0.02, 200), (3, 3e4, 90), (4, 1.0, 7)])
def test_equals_plain_rounds(spark, seed, spread, n, tmp_path):
    """Wide and narrow vectors: with few different whole numbers, ties are frequent."""
    r = random.Random(seed)
    rows = [(3 * i, [r.uniform(-spread, spread) for _ in range(32)], r.choice([0, 1, None])) for i in range(n)]
    rows[5:7] = [(rows[5][0], rows[5][1], 1), (rows[6][0], rows[5][1], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x.vec_id: x for x in vc.query(spark, str(tmp_path)).collect()}
    codes, errors, book = brute([(i, y, [int(np.floor(256 * c)) for c in v]) for i, v, y in rows])
    by = {y: sum(e for e, x in zip(errors, rows, strict=True) if x[2] == y) for y in (0, 1, None)}
    assert len(got) == n
    for (i, _, y), code, error in zip(rows, codes, errors, strict=True):
        assert (got[i].code, got[i].error, got[i].label_error, got[i].codebooks_sha256) == (code, error, by[y], book)


def test_bounds_spare_scans_and_never_lie():
    r = np.random.default_rng(7)
    x, old = r.integers(-60, 60, (5000, 4)), r.integers(-60, 60, (40, 4))
    old[3] = old[2]
    code, upper, lower = vc.scan(x, old)
    new = old + (r.random(old.shape) < 0.2)
    new[3] = new[2]  # equal entries: the lower index has all
    code, upper, lower, scanned = vc.kept_or_scanned(x, code, upper, lower, new, vc.moves(old, new))
    d = ((x[:, None] - new[None]) ** 2).sum(2)
    assert np.array_equal(code, d.argmin(1)) and 3 not in code
    true = np.sqrt(d)
    assert (upper >= true[np.arange(5000), code]).all() and (lower <= np.partition(true, 1, axis=1)[:, 1]).all()
    assert 0 < len(scanned) < 3500


def test_wide_numbers_are_exact():
    x = np.array([[1 << 27, -(1 << 27)], [0, 1]])
    c = np.array([[-(1 << 27), 1 << 27], [(1 << 27) - 1, 0]])
    assert vc.distances(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]


def test_odd_vectors(spark, tmp_path):
    """Null and non-finite vectors go, other lengths have no code, ids may be null or repeated."""
    v = [0.5] * 16
    nan = float("nan")
    rows = [(1, v, 5), (1, v, 5), (None, [-0.5] * 16, None), (2, [0.1] * 5, 5), (3, None, 1), (4, [None] * 16, 1), (5, [nan] * 16, 1), (6, [1e300] * 16, 7), (0, [], 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(((x.vec_id if x.vec_id is not None else 99), x.code, x.error, x.label_error) for x in vc.query(spark, str(tmp_path)).collect())
    assert got == [(0, None, None, 0), (1, "00" * 16, 0, 0), (1, "00" * 16, 0, 0), (2, None, None, 0), (6, "02" * 16, 0, 0), (99, "03" * 16, 0, 0)]
