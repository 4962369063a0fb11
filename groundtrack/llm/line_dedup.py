"""Line dedup by a deletion-neighbourhood join.

A line is a part of a text between line feeds; its words are lowered A-Z. A line of at least
`least` words goes if an earlier line (smaller doc_id, then smaller line number) has the same words,
or, from `near` words in the shorter one, differs by at most one word inserted, deleted or replaced.
Lines are judged on the input, not on what is left; shorter lines stay. `query` takes LEAST
and NEAR: every line with a word, and near copies from five words.

1. Equal lines meet by hash: only the first of each is looked at further.
2. Two lines within the bound share either their first or their second half exactly, so first lines
   without such a partner (most) leave here. The halves follow from the shorter line's length.
3. Each remaining line emits the hash of itself and of all its variants with one word deleted; equal
   hashes meet. The edit is verified by the place of the deleted word: two variants of equally long
   lines must have lost the word at the same place (one replaced word), a whole line may equal any
   variant of a longer one (one inserted word). The earliest of each group decides, so no pairs are
   emitted; of variants that lost the same place, only the earliest of a task's slice goes on, so a
   template line that most documents hold sends few rows.

Null text: no lines, and the text stays null. Empty text: one line, kept. Rows of one doc_id count
as one place, so equal lines at one line number remove none of each other; what goes is told by
doc_id and the text's hash, so texts of one doc_id lose only lines of their own. Null doc_id:
nothing is removed, and its lines remove none. Very long texts are one slice of a task each.
Further columns are kept by `dedup`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import _powers, cut, drop_cut, fresh, join_back, mix, prefix_sums, signed, slices, utf8, words

#: Of the query: all equal lines go; near copies from where one replaced word leaves 80 % equal.
LEAST, NEAR = 1, 5

_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


class Lines:
    """Word hashes of the lines of a slice, and hashes of runs of their words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        h, at, woffs = words(buf, offs)
        feeds = np.flatnonzero(buf == 10)
        doc_feeds = np.searchsorted(feeds, offs)  # line feeds before each text
        line = np.searchsorted(feeds, at)
        doc = np.repeat(np.arange(len(offs) - 1), np.diff(woffs))
        new = np.ones(len(h), bool)
        new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
        self.start = np.flatnonzero(new)
        self.end = np.append(self.start[1:], len(h)).astype(np.int64)
        self.n = self.end - self.start
        self.doc = doc[self.start]
        self.line = line[self.start] - doc_feeds[self.doc]
        most = int(self.n.max()) + 1 if len(self.n) else 1
        place = np.arange(len(h)) - np.repeat(self.start, self.n)
        self.up, self.down = _powers(most), _powers(most, _BACK)
        self.sums = prefix_sums(h * self.up[place])

    def run(self, k: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of words a to b of lines k, as if they were a line."""
        s = self.start[k]
        return (self.sums[s + b] - self.sums[s + a]) * self.down[a]


def _salted(x: np.ndarray, n: np.ndarray, kind: int) -> np.ndarray:
    return mix(mix(x) + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind))


def _profile(least: int, near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs):
                x = Lines(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                k = np.flatnonzero(x.n >= least)
                n = x.n[k]
                zero = np.zeros_like(n)
                keys = []
                for m in (n, n - 1):
                    half = m // 2
                    keys += [_salted(x.run(k, zero, half), m, 1), _salted(x.run(k, n - (m - half), n), m, 2)]
                keys = np.stack(keys, axis=1) if len(k) else np.zeros((0, 4), np.uint64)
                use = np.repeat(np.stack([n >= near, n - 1 >= near], axis=1), 2, axis=1) if len(k) else np.zeros((0, 4), bool)
                yield pa.record_batch(
                    {
                        "doc_id": batch.column(0).take(pa.array(a + x.doc[k])),
                        "t": batch.column(2).take(pa.array(a + x.doc[k])),
                        "line": pa.array(x.line[k]),
                        "h": signed(_salted(x.run(k, zero, n), n, 0)),
                        "keys": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(use.sum(axis=1))]).astype(np.int32)), signed(keys[use])),
                    }
                )

    return run


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text and lines (sorted numbers of those looked at). gone: a variant of the same
    slice that lost the same place is earlier; such a row meets no other."""
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        asked = batch.column(2)
        starts = np.asarray(asked.offsets)
        values = np.asarray(asked.values)
        for a, b in slices(offs):
            x = Lines(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
            doc = np.repeat(np.arange(b - a), np.diff(starts[a : b + 1]))
            want = doc * (1 << 40) + values[starts[a] : starts[b]]
            have = x.doc * (1 << 40) + x.line
            k = np.flatnonzero(np.isin(have, want))
            n = x.n[k]
            who = np.repeat(np.arange(len(k)), n)
            place = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
            kw, nw = k[who], n[who]
            # the words after the deleted one move one place down
            dropped = x.run(kw, np.zeros_like(place), place) + (x.sums[x.end[kw]] - x.sums[x.start[kw] + place + 1]) * x.down[1 if len(x.down) > 1 else 0]
            whole = x.run(k, np.zeros_like(n), n)
            who = np.concatenate([np.arange(len(k)), who])
            v = np.concatenate([_salted(whole, n, 3), _salted(dropped, nw - 1, 3)])
            place = np.concatenate([np.full(len(k), -1), place])
            ids, line = batch.column(0).to_numpy()[a + x.doc[k][who]], x.line[k][who]
            order = np.lexsort((line, ids, place, v))
            same = (v[order][1:] == v[order][:-1]) & (place[order][1:] == place[order][:-1])
            first = order[np.flatnonzero(np.concatenate([[True], ~same]))[np.cumsum(np.concatenate([[True], ~same])) - 1]] if len(order) else order
            gone = np.zeros(len(order), bool)
            gone[order] = (ids[order] != ids[first]) | (line[order] != line[first])
            h = _salted(whole, n, 0)[who]
            v[gone] = mix(h[gone] + place[gone].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            yield pa.record_batch({"v": signed(v), "place": pa.array(place.astype(np.int32)), "doc_id": pa.array(ids), "line": pa.array(line), "h": signed(h), "gone": pa.array(gone)})


def repeated_lines(docs: DataFrame, least: int = 5, near: int = 8) -> DataFrame:
    """doc_id, t (hash of the text) and lines (sorted array of the numbers from 0 of lines that go)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    lines = cut(docs.withColumn("t", F.xxhash64("text")).mapInArrow(_profile(least, near), "doc_id long, t long, line long, h long, keys array<long>"))
    at = F.struct("doc_id", "line")
    firsts = cut(lines.groupBy("h").agg(F.min(F.struct("doc_id", "line", "t", "keys")).alias("first"), F.count("*").alias("times")).select("h", "first.*", "times"))

    halves = firsts.select(F.explode("keys").alias("key"), "h", "doc_id", "line", "t")
    shared = halves.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    asked = halves.join(shared, "key").groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    texts = docs.join(asked.withColumnRenamed("doc_id", "of"), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("t")))
    variants = texts.select("doc_id", "text", "lines").mapInArrow(_variants, "v long, place int, doc_id long, line long, h long, gone boolean")
    group, same = Window.partitionBy("v"), Window.partitionBy("v", "place")
    variants = variants.withColumn("many", F.count("*").over(group)).where("many > 1 or gone")
    whole = F.min(F.when(F.col("place") == -1, at)).over(group)
    early = F.when(F.col("place") == -1, F.min(at).over(group)).otherwise(F.least(F.min(at).over(same), whole))
    near_gone = variants.withColumn("early", early).where(F.col("gone") | (F.col("early") < at)).select("h")

    # a near copy's equal lines all go; of other equal lines all but those at the first place
    again = firsts.where("times > 1").select("h", at.alias("first"), "times", F.lit(False).alias("all"))
    marks = again.unionByName(near_gone.select("h", F.lit(None).cast("struct<doc_id: bigint, line: bigint>").alias("first"), F.lit(1).cast("long").alias("times"), F.lit(True).alias("all")))
    marks = cut(marks.groupBy("h").agg(F.first("first", ignorenulls=True).alias("first"), F.max("times").alias("times"), F.max("all").alias("all")))
    gone = join_back(lines.select("h", "doc_id", "t", "line"), marks, "h", "times").where(F.col("all") | (at > F.col("first")))
    gone = cut(gone.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("line")).alias("lines")))
    for df in (lines, firsts, marks):
        drop_cut(df)
    return gone


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds the numbers of the lines that go."""
    for batch in batches:
        at, last = batch.schema.get_field_index("text"), batch.num_columns - 1
        texts = batch.column(at).to_pylist()
        for i, lost in enumerate(batch.column(last).to_pylist()):
            if lost and texts[i] is not None:
                lost = set(lost)
                texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in lost)
        columns = batch.columns[:last]
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:last]))


def _with_lost(docs: DataFrame, least: int, near: int) -> DataFrame:
    """The documents with one further, last column: the numbers of their lines that go, or null."""
    key, text, lost = fresh(docs, "_doc_id"), fresh(docs, "_t"), fresh(docs, "_gone")
    gone = repeated_lines(docs, least, near).select(F.col("doc_id").alias(key), F.col("t").alias(text), F.col("lines").alias(lost))
    same = (docs["doc_id"].cast("long") == F.col(key)) & (F.xxhash64(docs["text"].cast("string")) == F.col(text))
    return docs.join(gone, same, "left").drop(key, text)


def dedup(docs: DataFrame, least: int = 5, near: int = 8) -> DataFrame:
    """The documents, all their columns, with the repeated lines taken out of text."""
    return _with_lost(docs, least, near).mapInArrow(_rebuild, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: lines of each document, how many go, and which (numbers from 0, comma-joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    rows = _with_lost(docs, LEAST, NEAR)
    lost = F.col(rows.columns[-1])
    return rows.select(
        "doc_id",
        count.alias("n_lines"),
        F.coalesce(F.size(lost).cast("long"), F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.array_join(lost.cast("array<string>"), ","), F.lit("")).alias("removed"),
    )
