"""Language ID fitted in a task: the same machines as on the driver, from a sample with the same bound."""

import numpy as np
from pyspark.sql import functions as F

from groundtrack.llm import language_id


def test_same_machines(spark):
    words = {"en": "the house of my friend and a dog", "de": "das haus und der hund von mir", "fr": "la maison et le chien de mon ami"}
    texts = [(i, f"{words[k]} {words[k].split()[i % 7]} {i % 11}", k) for i in range(300) for k in words]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    here, away = language_id.train(docs), language_id.train(docs, in_task=True)
    assert here.languages == away.languages == [["de", "en"], ["fr"]] and here.rows == away.rows > 100
    for a, b in zip([here.top, *here.inner], [away.top, *away.inner], strict=True):
        assert np.allclose(a, b, atol=1e-3)
    assert language_id.train(docs.limit(0), in_task=True) is None
    assert language_id.train(docs.withColumn("text", F.lit("123")), in_task=True) is None


def test_bound(spark):
    """20,000 rows of one id and 10,000 without: no more than twice the parameter, equal rows once."""
    rows = spark.range(32_000).withColumn("doc_id", F.expr("CASE WHEN id < 20000 THEN 1L WHEN id < 30000 THEN NULL ELSE id END"))
    text = F.when(F.col("id") < 10_000, "the same words").otherwise(F.concat(F.lit("words about order "), F.col("id").cast("string")))
    docs = rows.select("doc_id", text.alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    assert 100 < language_id.train(docs, 300, in_task=True).rows <= 600
