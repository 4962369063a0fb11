"""What the classifiers bring to the driver is bounded, whatever repeats: ids, texts or both."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundtrack.llm import language_id, personal_data, quality


@pytest.fixture(scope="module")
def many(spark):
    """30,000 rows of id 1, 10,000 without id, 4,000 of other ids; half of the first are equal."""
    rows = spark.range(44_000).withColumn("doc_id", F.expr("CASE WHEN id < 30000 THEN 1L WHEN id < 40000 THEN NULL ELSE id END"))
    text = F.when(F.col("id") < 15_000, "the same words, call +1 (319) 555-5132").otherwise(F.concat(F.lit("call +1 (319) 555-5132 about order "), F.col("id").cast("string")))
    return rows.select("doc_id", text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))


def test_language_sample(many, monkeypatch):
    seen = []
    monkeypatch.setattr(language_id, "fit_svm", lambda x, y: seen.append(len(x)) or np.zeros(x.shape[1] + 1, np.float32))
    assert language_id.train(many, 300) is not None
    assert 100 < max(seen) <= 600


def test_labels_are_bounded(many, monkeypatch):
    monkeypatch.setattr(language_id, "LANGUAGES", 3)
    monkeypatch.setattr(language_id, "fit_svm", lambda x, y: np.zeros(x.shape[1] + 1, np.float32))
    # equal counts: the first by name; label 9 is the most frequent
    names = many.where("doc_id > 1").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "l9").otherwise(F.concat(F.lit("l"), (F.col("doc_id") % 4).cast("string"))))
    kinds = sorted(sum(language_id.train(names, 300).languages, []))
    assert len(kinds) == 3 and "l9" in kinds


@pytest.mark.parametrize("best", [[1], [1, 40_001, 40_003]])
def test_quality_samples(spark, many, monkeypatch, best):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda p, u: seen.append((len(p), len(u))))
    quality.train(many, spark.createDataFrame([(d, 1) for d in best] * 3, "doc_id long, quality int"), 200, 400)
    if seen:  # nothing to fit where no positive is drawn
        assert all(0 < p <= 400 and 0 < u <= 800 for p, u in seen)
    one = many.where("doc_id = 1").withColumn("doc_id", F.lit(2).cast("long"))
    both = many.unionByName(one)
    quality.train(both, spark.createDataFrame([(2, 1)], "doc_id long, quality int"), 200, 400)
    assert 50 < seen[-1][0] <= 400 and 50 < seen[-1][1] <= 800


def test_span_sample(many, monkeypatch):
    seen = []
    monkeypatch.setattr(personal_data, "examples", lambda windows: seen.append(len(windows)) or (None, None))
    monkeypatch.setattr(personal_data.Network, "fit", lambda self, ids, tags: self)
    assert personal_data.train(many, 300) is not None
    assert 100 < seen[0] <= 4 * 600
