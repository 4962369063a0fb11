"""Secret scan: candidates by pattern, false positives removed by a random forest.

Candidates are tokens of at least 16 characters of a-z, A-Z, 0-9, _, +, / and - (and closing =) that
hold a digit, mix cases inside or have a provider's prefix of capitals; signed web tokens of three
parts; blocks of private keys; and, of any length, values assigned to a credential's name that hold
none of these. The forest reads a candidate's length, shares of character classes and transitions
between classes, coverage of its words by a dictionary, the path (the column `source`) and the
neighbouring words, which are dealt over bins by their hash; all are built-in expressions and the
forest is Spark's own, so no Python runs on the executors. The dictionary holds the DICTIONARY most
frequent of the corpus' words of three to twelve letters.

The forest is trained from labelled findings (columns token, before, after, path and label). Where
none are given, `labelled` makes them from the corpus: tokens with a provider's prefix and tokens
assigned to a credential's name are secrets, the others are none. Neither rule is a feature: the
forest must find them again in the token's form and the words around it. About SAMPLE findings are
taken, by a hash of token, doc_id and place, so that a token that repeats is no more than its share.

Null text has no candidates; rows without doc_id keep null there; rows that repeat a doc_id each
give theirs. Very long texts are read whole by Spark's own expressions. An empty table, or labels of
one kind only, give candidates with the score of the labels (0 without any). Other columns are not
read.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import cut, share_of

WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
KEY_BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,20}PRIVATE KEY-----"
TOKEN = rf"{WEB_TOKEN}|{KEY_BLOCK}|" + r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z0-9_+/-]{16})(?=[A-Za-z_+/-]*[0-9]|[A-Z_+/-]*[a-z][a-z_+/-]*[A-Z]|AKIA|ASIA)[A-Za-z0-9_+/-]{16,}+={0,2}"
#: Labelled findings to learn from.
SAMPLE = 4000
DICTIONARY = 4096
#: Bins of the words before and after a candidate.
BEFORE, AFTER = 24, 8

#: Prefixes of providers' tokens, names of credentials, words beside other long tokens.
PREFIX = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk_live_|sk-|xoxb-|xoxp-|AIza)"
CREDENTIAL = r"(?i)(pass(word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,2}[=:]\s{0,2}[\"']?$"
ASSIGNED = r"(?i)(?:pass(?:word|wd|phrase)?|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"',;]+)"
OTHER = r"(?i)(commit|sha\d*|hash|uuid|guid|digest|checksum|example|phone|card|call|mail|version|isbn|order)"
TEST_PATH = r"(?i)(test|example|sample|mock|fixture|doc)"


def _matches(texts: DataFrame, pattern: str, group: int) -> DataFrame:
    """doc_id, start, token, before, after, path of each match; the token is the group at its end."""
    rows = texts.where(F.col("text").rlike(pattern))
    gaps = F.transform(F.split("text", pattern, -1), lambda g: F.struct(F.length(g).alias("n"), F.right(g, F.lit(32)).alias("before"), F.substring(g, 1, 16).alias("after")))
    found = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((0, "whole"), (group, "token"))), F.col("gaps").alias("gap"), F.slice("gaps", 2, 2147483647).alias("next"))
    rows = rows.select("doc_id", "path", "text", gaps.alias("gaps"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "path", "row", F.posexplode(found).alias("nth", "x")).where("x.whole is not null")
    sofar = Window.partitionBy("doc_id", "row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("x.gap.n") + F.length("x.whole")).over(sofar) - F.length("x.token")
    name = F.left("x.whole", F.length("x.whole") - F.length("x.token"))
    before = F.right(F.concat("x.gap.before", name), F.lit(32))
    return rows.select("doc_id", start.cast("long").alias("start"), F.col("x.token").alias("token"), before.alias("before"), F.col("x.next.after").alias("after"), "path")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, token, before, after, path of each candidate."""
    path = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), path.alias("path"))
    return _matches(texts, TOKEN, 0).unionByName(_matches(texts, ASSIGNED, 1).where(~F.col("token").rlike(TOKEN)))


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three to twelve letters; `size` of them reach the driver."""
    found = F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\b[a-z]{3,12}\b"), F.lit(0)))
    words = docs.select(found.alias("word")).groupBy("word").count()
    return [r.word for r in words.orderBy(F.desc("count"), "word").limit(size).collect()]


def with_features(rows: DataFrame, words: list[str]) -> tuple[DataFrame, list[str]]:
    token, n = F.col("token"), F.length("token")
    count = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    known = F.from_json(F.lit(json.dumps(words)), "array<string>")
    parts = F.regexp_extract_all(token, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    covered = F.aggregate(F.filter(parts, lambda p: F.array_contains(known, F.lower(p))), F.lit(0), lambda total, p: total + F.length(p)) / n
    beside = lambda c, pattern, bins: F.pmod(F.xxhash64(F.lower(F.regexp_extract(c, pattern, 1))), F.lit(bins))
    last, following = beside("before", "([A-Za-z]+)[^A-Za-z]*$", BEFORE), beside("after", "^[^A-Za-z]*([A-Za-z]+)", AFTER)
    made: dict[str, Column] = {
        "f_length": n.cast("double"),
        "f_digit": count("[0-9]"), "f_upper": count("[A-Z]"), "f_lower": count("[a-z]"), "f_vowel": count("[aeiouAEIOU]"), "f_beyond_hex": count("[g-zG-Z]"),
        "f_to_digit": count("[A-Za-z](?=[0-9])"), "f_to_letter": count("[0-9](?=[A-Za-z])"), "f_to_upper": count("[a-z](?=[A-Z])"), "f_to_lower": count("[A-Z](?=[a-z])"), "f_repeat": count("(.)(?=\\1)"),
        "f_distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "f_dictionary": covered,
        "f_test_path": flag(F.col("path").rlike(TEST_PATH)), "f_path_depth": F.coalesce(F.regexp_count("path", F.lit("/")), F.lit(0)).cast("double"),
        "f_assigned": flag(F.col("before").rlike("[=:\"']\\s{0,2}$")),
        "f_other_word": flag(F.col("before").rlike(OTHER)), "f_quoted": flag(F.col("after").rlike("^[\"']")), "f_spaced": flag(F.col("after").rlike("^(\\s|$)")),
    }
    made |= {f"f_before_{k}": flag(last == k) for k in range(BEFORE)} | {f"f_after_{k}": flag(following == k) for k in range(AFTER)}
    return rows.withColumns({k: v.cast("double") for k, v in made.items()}), list(made)


def labelled(rows: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Findings with a label, made from the candidates themselves."""
    secret = F.col("token").rlike(PREFIX) | F.col("before").rlike(CREDENTIAL)
    n = rows.count()
    return rows.where(share_of(F.xxhash64("token", "doc_id", "start"), sample / max(1, n), 17)).withColumn("label", F.coalesce(secret, F.lit(False)).cast("double"))


def train(findings: DataFrame, words: list[str], trees: int = 20, depth: int = 6):
    """The forest, or the one label's value where there is no other."""
    rows, names = with_features(findings, words)
    kinds = sorted(r.label for r in rows.select("label").distinct().collect())
    if len(kinds) < 2:
        return kinds[0] if kinds else 0.0
    # one sorted partition of bounded size, so that the trees' samples are the same in each run
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows.repartition(1).sortWithinPartitions("token", "before", "after", "doc_id", "start"))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, seed=7).fit(rows.select("features", "label"))


def scan(rows: DataFrame, forest, words: list[str], least: float = 0.5) -> DataFrame:
    """doc_id, start, length, token, score, secret of each candidate."""
    rows, names = with_features(rows, words)
    if isinstance(forest, float):
        rows = rows.withColumn("score", F.lit(forest))
    else:
        rows = forest.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
        rows = rows.withColumn("score", vector_to_array("probability")[1])
    return rows.select("doc_id", "start", F.length("token").cast("long").alias("length"), "token", "score", (F.col("score") >= least).alias("secret"))


def find(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """Scan of the documents by a forest trained from the findings given, or from `labelled` ones."""
    rows = cut(candidates(docs))
    words = dictionary(docs)
    return scan(rows, train(cut(labelled(rows)) if findings is None else findings, words), words)


def query(spark, sf_dir: str) -> DataFrame:
    """op6: each candidate with its score; the token itself is shown as its hash."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("token", F.sha2("token", 256)).withColumnRenamed("token", "token_sha256")
