"""Phrases that are more than their parts: collocations by merged count-min sketches and exact counts.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words
`[^\\x20\\x09]+`; all counts are per lang (null: `und`). A phrase is 2 to 4 words in a row within a
piece. Its score is the least over its cuts of 2,000,000 * f(phrase) / (f(first) + f(rest)), floored.

1. Each task adds what it reads into a sketch of two rows of saturating counters; the sketches of all
   tasks are merged chunk by chunk as a stream, and one bit a cell is kept: whether the merged count
   reaches the least frequency. A count is never underestimated, so no frequent phrase loses its bits.
   The first sketch holds words and pairs; the second longer phrases whose pairs all have their bits.
2. A second pass counts exactly, by their text, the occurrences whose bits are set; what is too rare
   goes. Parts of a frequent phrase are at least as frequent, so their counts are all there.
3. Phrases meet the counts of the first and last part of each cut in one join, and the greatest count
   of a longer phrase around them in another; phrases that a longer one stands for go, and the best of
   each lang are ranked, in parts first.

Sketches grow with the corpus (a cell for 32 bytes of text) up to CELLS a row: 128 MB in a task, 16 MB
of bits on the driver and in the executors. Beyond that more rare phrases pass to the exact counts:
results stay the same, the second pass shuffles more. Sketching tasks are merged to a few for each
core, so that the sketches are a small part of the input.

Null and empty texts, and texts without words, add nothing; a lang without frequent phrases has no
rows. Rows that repeat a doc_id each count. Texts of any length are read in regions cut between
words, with no seam. Equal 64-bit hashes within one region of 2 MB count as equal phrases; across
regions texts are compared. Columns other than text and lang are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import _LOWER, _MULT, cut, drop_cut, mix, regions, run_hashes, utf8

#: Most cells of a sketch's row, rows of a sketch, cells of a chunk, bytes of text for which there is one cell.
CELLS, DEPTH, CHUNK, SHARE = 1 << 26, 2, 1 << 14, 32
#: Bytes of text that are worked on at once.
REGION = 1 << 21
#: Candidates of a part of a lang that are ranked together before the parts meet.
RANKED = 1 << 17

_SEP = np.zeros(256, bool)
_SEP[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _SEP.copy()
_GAP[[9, 32]] = True


class Grams:
    """Words of a batch of texts, a region at a time, and the phrases that end in it."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, seeds: np.ndarray, longest: int):
        self.buf, self.offs, self.seeds, self.longest = buf, offs, seeds, longest

    def __iter__(self) -> Iterator[Grams]:
        """Of each region: at, end, doc of the words, old (those before it, for phrases across its edge),
        keys (hashes, with the lang) and runs (starts in the words) of the phrases by number of words."""
        keep = self.longest - 1
        at, end, h, part = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        seps = 0
        for a, b in regions(self.buf, self.offs, _GAP, REGION):
            piece = self.buf[a:b]
            word = ~_GAP[piece]
            edge = np.concatenate([[True], ~word[:-1]])
            inner = self.offs[(self.offs > a) & (self.offs < b)] - a
            edge[inner] = True
            starts = np.flatnonzero(word & edge)
            stop = np.concatenate([~word[1:], [True]])
            stop[inner - 1] = True
            ends = np.flatnonzero(word & stop) + 1
            sep = np.flatnonzero(_SEP[piece])
            new_part = np.searchsorted(sep, starts) + seps
            seps += len(sep)
            self.old = len(at[-keep:]) if keep else 0
            tail = slice(len(at) - self.old, None)
            at, end, part = (np.concatenate([x[tail], y]) for x, y in ((at, starts + a), (end, ends + a), (part, new_part)))
            h = np.concatenate([h[tail], run_hashes(self.buf, starts + a, ends + a, _LOWER)])
            self.at, self.end = at, end
            self.doc = np.searchsorted(self.offs, at, "right") - 1
            same = (part[1:] == part[:-1]) & (self.doc[1:] == self.doc[:-1])
            key, whole = mix(h ^ self.seeds[self.doc]), np.ones(len(h), bool)
            self.keys, self.runs = [], []
            for k in range(1, self.longest + 1):
                if k > 1:
                    n = max(0, len(h) - k + 1)
                    key = mix(key[:n] * _MULT + h[k - 1 :])
                    whole = whole[:n] & same[k - 2 :][:n]
                runs = np.flatnonzero(whole[max(0, self.old - k + 1) :]) + max(0, self.old - k + 1)
                self.keys.append(key)
                self.runs.append(runs)
            yield self

    def texts(self, start: np.ndarray, k: np.ndarray) -> pa.Array:
        """The phrases of k words at these words, lower-cased and joined by single spaces."""
        segment = np.concatenate([[0], np.cumsum(k)])
        word = np.repeat(start - segment[:-1], k) + np.arange(segment[-1])
        last = np.zeros(len(word), bool)
        last[segment[1:] - 1] = True
        size = self.end[word] - self.at[word] + ~last
        upto = np.concatenate([[0], np.cumsum(size)])
        out = np.arange(upto[-1])
        out += np.repeat(self.at[word] - upto[:-1], size)
        out = _LOWER[self.buf[out]]
        out[upto[1:][~last] - 1] = 32
        offsets = upto[segment].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))


def _batches(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Grams, pa.Array]]:
    """Phrases of each batch of (lang, text), and its langs."""
    for batch in batches:
        lang = batch.column("lang").dictionary_encode()
        seeds = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in lang.dictionary.to_pylist()]
        buf, offs = utf8(batch.column("text"))
        yield Grams(buf, offs, np.array(seeds, np.uint64)[lang.indices.to_numpy()] if len(lang) else np.zeros(0, np.uint64), longest), batch.column("lang")


def _cells(keys: np.ndarray, width: int) -> list[np.ndarray]:
    """A cell of each row of the sketch."""
    return [((keys >> np.uint64(32 * r)) & np.uint64(width - 1)).astype(np.uint32) for r in range(DEPTH)]


def _reach(bits: list[np.ndarray], keys: np.ndarray, width: int) -> np.ndarray:
    """Whether the merged counts of these phrases reach the least frequency."""
    ok = np.ones(len(keys), bool)
    for row, cell in zip(bits, _cells(keys, width), strict=True):
        ok &= (row[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 == 1
    return ok


def _sifted(grams: Grams, found: list[list[np.ndarray]], width: int) -> list[np.ndarray]:
    """Starts of the phrases, by number of words, that the sketches so far do not rule out."""
    runs = list(grams.runs)
    if not found:
        return runs
    pair = _reach(found[0], grams.keys[1], width) if grams.longest > 1 else np.zeros(0, bool)
    for k, at in enumerate(runs, 1):
        if k == 2:
            runs[1] = at[pair[at]]
        elif k > 2:
            ok = np.ones(len(at), bool)
            for j in range(k - 1):
                ok &= pair[at + j]
            runs[k - 1] = at[ok]
    runs[0] = runs[0][_reach(found[0], grams.keys[0][runs[0]], width)]
    for k in range(3, grams.longest + 1) if len(found) > 1 else ():
        runs[k - 1] = runs[k - 1][_reach(found[1], grams.keys[k - 1][runs[k - 1]], width)]
    return runs


def sketch(rows: DataFrame, sizes: range, longest: int, least: int, width: int, found) -> list[np.ndarray]:
    """Bits of the merged sketch of phrases of these numbers of words; found: the sketches before it, as a broadcast."""
    chunk = min(width, CHUNK)
    kind, most = (np.uint8, 255) if least <= 255 else (np.uint32, 2**32 - 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((DEPTH, width), kind)
        for grams, _ in _batches(batches, longest):
            for region in grams:
                runs = _sifted(region, found.value, width)
                keys = np.concatenate([region.keys[k - 1][runs[k - 1]] for k in sizes])
                for row, cell in zip(table, _cells(keys, width), strict=True):
                    cell.sort()
                    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
                    one = cell[first]
                    row[one] = np.minimum(row[one].astype(np.int64) + np.diff(np.append(first, len(cell))), most)
        table = table.reshape(-1, chunk)
        some = np.flatnonzero(table.any(axis=1))
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in table[part]], pa.binary())], ["chunk", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def told():
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])

        for batch in batches:
            for c, cells in zip(batch.column("chunk").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                if c != now:
                    if now is not None:
                        yield told()
                    now, total = c, np.zeros(chunk, np.int64)
                total = np.minimum(total + np.frombuffer(cells, kind), most)
        if now is not None:
            yield told()

    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(2 * cores).mapInArrow(count, "chunk int, cells binary")
    merged = parts.repartition(max(cores, DEPTH * width // chunk // 64), "chunk").sortWithinPartitions("chunk").mapInArrow(merge, "chunk int, bits binary")
    bits = np.zeros((DEPTH * width // chunk, chunk // 8), np.uint8)
    for r in merged.collect():  # at most DEPTH * CELLS / 8 bytes
        bits[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return list(bits.reshape(DEPTH, -1))


def counts(docs: DataFrame, longest: int = 4, least: int = 30) -> DataFrame:
    """lang, phrase, k (its words), f: all phrases of up to `longest` words that occur `least` times or
    more, single words included; and one row a lang with k 0, no phrase, and f the number of its words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("octet_length(text) > 0")
    sc = rows.sparkSession.sparkContext
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = 1 << max(12, min(CELLS.bit_length() - 1, int(size // SHARE).bit_length()))
    found = []
    for sizes in (range(1, min(2, longest) + 1), range(3, longest + 1)):
        if sizes:
            found.append(sketch(rows, sizes, longest, least, width, sc.broadcast(list(found))))
    told = sc.broadcast(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "phrase", "k", "f"]
        for grams, langs in _batches(batches, longest):
            for region in grams:
                new = np.bincount(region.doc[region.old :], minlength=len(langs))
                some = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(some)).cast(pa.string()), pa.nulls(len(some), pa.string()), pa.array(np.zeros(len(some), np.int32)), pa.array(new[some])], names)
                runs = _sifted(region, told.value, width)
                keys = np.concatenate([region.keys[k][at] for k, at in enumerate(runs)])
                start = np.concatenate(runs)
                k = np.repeat(np.arange(1, longest + 1), [len(at) for at in runs])
                _, first, n = np.unique(keys, return_index=True, return_counts=True)
                for a in range(0, len(first), 50_000):
                    one = first[a : a + 50_000]
                    lang = langs.take(pa.array(region.doc[start[one]])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([lang, region.texts(start[one], k[one]).cast(pa.string()), pa.array(k[one].astype(np.int32)), pa.array(n[a : a + 50_000])], names)

    every = rows.mapInArrow(count, "lang string, phrase string, k int, f long")
    return every.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.sum("f").alias("f")).where(f"k = 0 or f >= {least}")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, best: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each lang's best phrases."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    known = cut(counts(docs, longest, least))
    many = known.where("k > 1").count()
    exact = lambda c: F.col(c).cast("decimal(20,0)")

    words = F.split("phrase", " ")
    cuts = known.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"), "k")
    sides = "array(named_struct('side', 0, 'part', substring_index(phrase, ' ', c)), named_struct('side', 1, 'part', substring_index(phrase, ' ', c - k)))"
    cuts = cuts.select("lang", "phrase", "a", "c", F.explode(F.expr(sides)).alias("p"))
    cuts = cuts.select("lang", "phrase", "a", "c", F.col("p.side").alias("side"), F.col("p.part").alias("part"))
    met = cuts.join(known.where("k > 0").select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    side = lambda c, s: F.max(F.when((F.col("c") == c) & (F.col("side") == s), F.col("f"))).alias(f"f{c}_{s}")
    met = met.groupBy("lang", "phrase", "a").agg(*[side(c, s) for c in range(1, longest) for s in (0, 1)])
    score = lambda c: F.expr(f"(cast(a as decimal(20,0)) * 2000000bd) div (cast(f{c}_0 as decimal(20,0)) + cast(f{c}_1 as decimal(20,0)))")
    each = [F.when(F.col(f"f{c}_0").isNotNull(), F.struct(score(c).alias("score"), F.lit(c).alias("c"), F.col(f"f{c}_0").alias("l"), F.col(f"f{c}_1").alias("r"))) for c in range(1, longest)]
    scored = met.select("lang", "phrase", "a", F.array_min(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("cut"))

    inner = known.where("k > 2").select("lang", F.col("f").alias("around"), words.alias("w"), "k")
    inner = inner.select("lang", "around", "w", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "around", "w", "m", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("m") + 1)).alias("i"))
    inner = inner.select("lang", "around", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
    alone = F.col("around").isNull() | (exact("around") * 100 < exact("a") * share)
    kept = scored.join(inner, ["lang", "phrase"], "left").where(alone).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))

    order = (F.col("score").desc(), F.col("a").desc(), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(1, many // RANKED)))
    first = Window.partitionBy("lang", part).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    out = cut(kept.join(known.where("k = 0").select("lang", F.col("f").alias("n")), "lang"))
    drop_cut(known)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: each lang's 2,000 best phrases."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase FROM w, range(1, 5) r(k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
q AS MATERIALIZED (
  SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 : k], ' ') AS rest FROM c, range(1, 4) q(j) WHERE j < k),
s AS (
  SELECT lang, q.phrase, a, j, x.f AS l, y.f AS r, CAST((2000000 * a::HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM q JOIN (SELECT lang, phrase AS first, f FROM f) x USING (lang, first) JOIN (SELECT lang, phrase AS rest, f FROM f) y USING (lang, rest)),
b AS (SELECT lang, phrase, a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM s GROUP BY ALL),
i AS (
  SELECT lang, array_to_string(w[st : st + m - 1], ' ') AS phrase, max(a) AS around
  FROM c, range(2, 4) q(m), range(1, 4) o(st) WHERE m < c.k AND st + m - 1 <= c.k GROUP BY ALL),
t AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, score
  FROM b LEFT JOIN i USING (lang, phrase) WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""
