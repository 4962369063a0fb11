"""Exact top-k search by vector-approximation files.

A component x of a vector becomes floor(64 * x); the score is the integer inner product.

1. Equal vectors are one candidate that holds the k + 1 smallest vec_ids of its rows: ties go to
   the smaller vec_id, so the others cannot be among the k best, however many rows are equal.
2. Candidates are dealt over blocks by a hash, and each block's approximation file is written: a
   cell number of one byte for each component, and the grid of these cells.
3. Each block of queries scans each file. Cells give a lower and an upper bound of each score; the
   first scan tells each query's least score worth reading (the greatest of the files' k-th lower
   bounds, the query's own row aside), the second the candidates whose upper bound reaches it.
4. The exact vectors of these are read in the order of their bounds: for each query the k + 1 first
   ones, then those whose bound reaches the k-th score that these have made certain (equal bounds
   are read, for ties go to the smaller vec_id).

Files and query blocks are of bounded size; vectors are shuffled once, to meet their equals, and
later only those that are read. A query's best are kept by rank within tasks before the shuffle.

Vectors that are null or hold null or non-finite components take no part, nor do rows without
vec_id. With `each_row`, rows that repeat a vec_id are candidates (and queries) each; else a vec_id
counts once, with its smallest vector. Vectors of another length than the query's are no candidates
of it. With fewer than k candidates, all are given. An empty table gives an empty result; columns
other than vec_id and embedding are not read. Bounds allow for the rounding of doubles and exact
scores of large components are computed as Python's integers; scores outside of a long's range are
held at its end, and components of 2**1018 or more in size count as 2**1024 less the last place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import cut, drop_cut

#: Candidates of a file and queries of a block.
ROWS, QUERIES = 8192, 2048
#: Queries of a block that are held against a file at once.
STEP = 256

_FILE = "block int, dims int, names binary, low binary, width binary, cells binary"
_ASKS = "ask int, dims int, names binary, q binary, least binary"


def quantised(vectors: DataFrame, each_row: bool = False) -> DataFrame:
    """vec_id and v, the integer vector (as whole doubles), of rows that take part."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    top = float(np.finfo(float).max)
    whole = lambda c: F.when(F.abs(c * 64) < 2.0**53, F.floor(c * 64).cast("double")).otherwise(F.least(F.lit(top), F.greatest(F.lit(-top), c * 64)))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
    return rows if each_row else rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _approximation(rows: pd.DataFrame) -> pd.DataFrame:
    """The approximation file of a block's vectors, all of one length."""
    v = np.stack(rows.v.to_numpy())
    low, high = v.min(axis=0), v.max(axis=0)
    with np.errstate(over="ignore"):
        spread = np.minimum(high - low, np.finfo(float).max)
    width = 2.0 ** np.maximum(0, np.ceil(np.log2(spread + 1)) - 8)
    with np.errstate(over="ignore"):
        cells = np.minimum(np.floor(np.minimum(v - low, np.finfo(float).max) / width), 255).astype(np.uint8)
    one = (int(rows.block.iloc[0]), v.shape[1], rows.name_.to_numpy(np.int64).tobytes(), low.tobytes(), width.tobytes(), cells.tobytes())
    return pd.DataFrame([one], columns=["block", "dims", "names", "low", "width", "cells"])


def _asked(rows: pd.DataFrame) -> pd.DataFrame:
    """A block of queries, all of one length."""
    one = (int(rows.ask.iloc[0]), len(rows.v.iloc[0]), rows.name_.to_numpy(np.int64).tobytes(), np.stack(rows.v.to_numpy()).tobytes(), rows.least.to_numpy(float).tobytes())
    return pd.DataFrame([one], columns=["ask", "dims", "names", "q", "least"])


def _bounds(row) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a file and a block of queries, some queries at a time: their names and least scores, the
    candidates' names, and the lower and upper bounds of the scores."""
    numbers = lambda x, kind=float: np.frombuffer(x, kind)
    low, width, d = numbers(row.low), numbers(row.width), max(1, row.dims)
    names, asked = numbers(row.names, np.int64), numbers(row.asked, np.int64)
    cells = numbers(row.cells, np.uint8).reshape(len(names), row.dims).astype(float)
    q, least = numbers(row.q).reshape(len(asked), row.dims), numbers(row.least)
    for a in range(0, len(asked), STEP):
        part = q[a : a + STEP]
        with np.errstate(over="ignore", invalid="ignore"):
            corner = (part * width) @ cells.T + (part @ low)[:, None]
            off = 2.0**-50 * d * (np.abs(part) * (np.abs(low) + 256 * width)).sum(axis=1)
            down = corner + (np.minimum(part, 0) * (width - 1)).sum(axis=1)[:, None] - off[:, None]
            up = corner + (np.maximum(part, 0) * (width - 1)).sum(axis=1)[:, None] + off[:, None]
        told = np.isfinite(down) & np.isfinite(up)
        # scores are held within a long, and so are their bounds
        down, up = np.clip(np.where(told, down, -np.inf), -(2.0**63), 2.0**63), np.clip(np.where(told, up, np.inf), -(2.0**63), 2.0**63)
        yield asked[a : a + STEP], least[a : a + STEP], names, down, up


def _worth(k: int):
    """asked and least: the lower bound of the k + 1-th of a file's candidates, for each query."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            for row in rows.itertuples():
                for asked, _, names, down, _ in _bounds(row):
                    n = len(names)
                    if n > k:
                        yield pd.DataFrame({"asked": asked, "least": np.partition(down, n - k - 1, axis=1)[:, n - k - 1]})

    return run


def _survivors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """asked, found and bound of the candidates whose upper bound reaches the query's least score."""
    for rows in parts:
        for row in rows.itertuples():
            for asked, least, names, _, up in _bounds(row):
                i, j = np.nonzero(up >= least[:, None])
                yield pd.DataFrame({"asked": asked[i], "found": names[j], "bound": up[i, j]})


def inner(q: np.ndarray, v: np.ndarray) -> int:
    """Inner product of whole numbers, held within a long."""
    with np.errstate(over="ignore"):
        small = float(np.abs(q) @ np.abs(v)) < 2.0**53
    exact = int(q @ v) if small else sum(int(a) * int(b) for a, b in zip(q, v, strict=True))
    return max(-(1 << 63), min((1 << 63) - 1, exact))


def _scored(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """asked, query_id, vec_id and score of each candidate's rows but the query's own one."""
    for rows in parts:
        scores = [inner(q, v) for q, v in zip(rows.q, rows.v, strict=True)]
        ids = []
        for x, own, q, v in zip(rows.ids, rows.query_id, rows.q, rows.v, strict=True):
            ids.append(np.delete(x, np.flatnonzero(x == own)[:1]) if np.array_equal(q, v) else x)
        n = [len(x) for x in ids]
        yield pd.DataFrame(
            {"asked": np.repeat(rows.asked.to_numpy(), n), "query_id": np.repeat(rows.query_id.to_numpy(), n), "vec_id": np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64), "score": np.repeat(np.array(scores, np.int64), n)}
        )


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: both tables as quantised() gives them."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    equal = vectors.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = cut(equal.withColumn("found", F.monotonically_increasing_id()))
    asks = cut(queries.select("vec_id", "v").withColumn("asked", F.monotonically_increasing_id()))
    n_blocks, n_asks = (max(1, -(-df.count() // n)) for df, n in ((groups, ROWS), (asks, QUERIES)))

    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    files = groups.select(F.col("found").alias("name_"), "v", place("found", n_blocks).alias("block"))
    files = cut(files.groupBy("block", F.size("v").alias("dims")).applyInPandas(_approximation, _FILE))

    def met(least: DataFrame) -> DataFrame:
        """Each file with each block of queries; least holds asked and the least score worth reading."""
        rows = asks.join(least, "asked", "left").select(F.col("asked").alias("name_"), "v", place("asked", n_asks).alias("ask"), F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        blocks = rows.groupBy("ask", F.size("v").alias("dims")).applyInPandas(_asked, _ASKS).withColumnRenamed("names", "asked")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        return files.withColumn("ask", every(n_asks)).join(blocks.withColumn("block", every(n_blocks)), ["block", "ask", "dims"])

    none = asks.select("asked", F.lit(None).cast("double").alias("least"))
    least = cut(met(none).mapInPandas(_worth(k), "asked long, least double").groupBy("asked").agg(F.max("least").alias("least")))
    best = Window.partitionBy("asked").orderBy(F.col("bound").desc(), "found")
    reached = met(least).mapInPandas(_survivors, "asked long, found long, bound double")
    reached = cut(reached.withColumn("nth", F.row_number().over(best)))

    def scored(rows: DataFrame) -> DataFrame:
        rows = rows.select("asked", "found").join(groups, "found").join(asks.select("asked", F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "asked")
        return rows.mapInPandas(_scored, "asked long, query_id long, vec_id long, score long")

    order = Window.partitionBy("asked").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = cut(ranked(scored(reached.where(F.col("nth") <= k + 1))))
    sure = first.where(F.col("rank") == k).select("asked", F.col("score").alias("sure"))
    rest = reached.where(F.col("nth") > k + 1).join(sure, "asked", "left").where(F.col("sure").isNull() | (F.col("bound") >= F.col("sure")))
    out = cut(ranked(first.drop("rank").unionByName(scored(rest))))
    for df in (files, reached, first, groups, asks, least):
        drop_cut(df)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the 20 best for each row whose vec_id is divisible by 20."""
    vectors = cut(quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), each_row=True))
    return search(vectors, vectors.where("vec_id % 20 = 0"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.r <> d.r AND len(q.v) = len(d.v) WHERE q.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM t WHERE rank <= 20
"""
