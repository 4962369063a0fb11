"""Every query of the corpus operators, and the pipeline's stages, on tables that no one would wish for."""

import random

import pytest

import corpus_pipeline
from groundtrack.llm import registry

#: Columns that a table may bring along and that operators use for something else.
CLASHES = "score string, held_out long, size string, n long, h string, a long, b long, g string, component_id string, _nth long, lang_pred long, row string, hash long, target string, taken string, start string, key string, v string, line string, place string, n_links string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
WIDTH = len(CLASHES.split(","))


def texts(r):
    words = [f"wort{i}" for i in range(90)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = prose(60)
    some = [prose(40) + "\n" + shared + "\n" + prose(r.randrange(3, 30)) for _ in range(12)]
    odd = [None, "", "   ", "\n\n", "a", "\x00\x01", "💬 é ü", "12345", "@", "+", "-", "x" * 300_000, "word " * 60_000, "\n".join(["one more line of text"] * 3000), "1 " * 50_000]
    return some + odd + some[:3] + [some[0] + " end", some[0]]


def folder(spark, path, docs, labels, benchmark, vectors):
    tables = {
        "documents": spark.createDataFrame(docs, DOCS),
        "labels": spark.createDataFrame(labels, f"doc_id long, quality int, toxic int, text string, {CLASHES}"),
        "benchmark": spark.createDataFrame(benchmark, f"item_id long, text string, doc_id string, {CLASHES}"),
        "embeddings": spark.createDataFrame(vectors, f"vec_id long, embedding array<float>, label int, query_id string, rank string, {CLASHES}"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    r, more = random.Random(3), (None,) * WIDTH
    rows = texts(r)
    docs = [(i, t, r.choice(["en", "de", None]), r.choice(["s", "t", "", None]), None, *more) for i, t in enumerate(rows)]
    docs += [docs[2], docs[2], (docs[3][0], "another text of this id", "en", "s", 1, *more)]
    docs += [(None, rows[0], "en", "s", 1, *more), (None, None, None, None, None, *more), (-7, rows[1], "de", "s", 1, *more)]
    labels = [(i, r.choice([0, 1, None]), None, None, *more) for i in range(10)] + [(1, 1, 0, None, *more), (1, 0, 0, None, *more), (None, 1, 1, None, *more)]
    benchmark = [(0, rows[1][30:200], None, *more), (0, rows[1][30:200], None, *more), (1, None, None, *more), (None, "", None, *more), (2, "short", None, *more)]
    nan, inf = float("nan"), float("inf")
    vectors = [(i, v, None, None, None, *more) for i, v in [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 0.0]), (4, [inf, 0.0]), (40, []), (None, [1.0, 1.0]), (5, [1e30, -1e30]), (6, [0.0, 0.0])]]
    return folder(spark, tmp_path_factory.mktemp("odd"), docs, labels, benchmark, vectors), docs


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return folder(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


ROW_A_DOCUMENT = ["op1_quality", "op2_source_mix", "op3_personal_data", "op8_suffix_dedup", "op9_jaccard_join", "op10_language_id"]


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_rows(spark, odd, name):
    path, docs = odd
    got = registry.QUERIES[name](spark, path)
    rows = got.collect()
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    if name in ROW_A_DOCUMENT:
        assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(d[0] for d in docs if d[0] is not None)
        assert sum(r.doc_id is None for r in rows) == 2
    if name == "op5_topk":
        assert {r.query_id for r in rows} == {0, 20} and all(r.vec_id not in (1, 2, 3, 4) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_rows(spark, empty, name):
    got = registry.QUERIES[name](spark, empty)
    assert got.collect() == [] and got.columns


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_one_by_one(spark, odd, empty, name, stage):
    path, docs = odd
    table = spark.read.parquet(f"{path}/documents.parquet")
    got = stage(spark, table, path)
    rows = got.collect()
    assert got.columns[: len(table.columns)] == table.columns and len(rows) <= len(docs)
    if name != "source_mix":
        assert got.dtypes == table.dtypes
    if name == "line_dedup":
        assert len(rows) == len(docs)
    assert stage(spark, spark.read.parquet(f"{empty}/documents.parquet"), empty).collect() == []


def test_pipeline_of_odd_rows(spark, odd, empty):
    assert 0 < corpus_pipeline.run(spark, odd[0]).count() <= len(odd[1])
    assert corpus_pipeline.run(spark, empty).count() == 0
