"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over a span of words say which positions count; the others may differ. Each position of
each benchmark item and of each document is hashed once per mask, equal hashes are joined, and
around each hit the two texts are laid over each other: a hit holds if some window of `least`
aligned words (the whole item, if shorter) around it has at least `share` equal words.

The masks leave no tolerated substitution out: a window in which t words may differ is cut into
t + 2 parts, and each mask counts two of these, so that some mask misses every changed word,
wherever they stand. Windows of 13 words at 80 % tolerate two: four parts of three or four words, of which
three masks remain, as others fit wherever these do. The same rule makes the masks of items shorter
than a window, down to one word (of which none may differ).

The benchmark is the stated query set. Its hashes are sent to the tasks in blocks of at most
BLOCK_WORDS words, one pass over the documents for each block, so what is sent has a fixed bound
and no document moves. Words are runs of ASCII letters and digits and other characters; A-Z are
lowered.

Hits are laid over each other a bounded number at a time, whatever a phrase's frequency.

Null or empty text: nothing is found. Items without id or words take no part. A very long text is one
slice. Rows that repeat a doc_id each give their pairs. An empty table gives an empty result;
further columns of either table are passed over (find) or kept (clean).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack.llm.common import PUNCTUATION, mix, slices, utf8, words

#: Hits that are laid over each other at once.
HITS = 1 << 17
#: Words of the benchmark that are sent at once.
BLOCK_WORDS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def masks(words: int, changes: int) -> list[str]:
    """Masks over a window of words (1: the word counts; 0: it may differ), of which one fits wherever
    at most so many words differ."""
    parts = min(changes + 2, words)
    edges = [words * k // parts for k in range(parts + 1)]
    out = []
    for chosen in combinations(range(parts), max(1, parts - changes)):
        out.append("".join("1" if any(edges[k] <= i < edges[k + 1] for k in chosen) else "0" for i in range(words)))
    return out


def sliding(masks: list[str]) -> list[str]:
    """The masks that are needed where each is tried at every place: none in which another one fits."""
    shapes = sorted({m.strip("0") for m in masks}, key=lambda m: (m.count("1"), len(m), m))
    fits = lambda small, big: any(all(b == "1" for a, b in zip(small, big[k:], strict=False) if a == "1") for k in range(len(big) - len(small) + 1))
    kept: list[str] = []
    for shape in shapes:
        if not any(fits(k, shape) for k in kept):
            kept.append(shape)
    return kept


def _seeds(h: np.ndarray, offs: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the counted words at each position where the mask fits into a text."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            acc = acc * _STEP + h[j : j + n]
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    fits = np.flatnonzero(text[:n] == text[len(mask) - 1 :])
    return mix(acc[fits] + np.uint64(int(mask, 2))), fits


class Items:
    """Word hashes and seed hashes of one block of benchmark items."""

    def __init__(self, rows: list, least: int, share: float):
        buf, offs = utf8(pa.array([r[1] for r in rows], pa.string()))
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.h, _, self.offs = words(buf, offs, PUNCTUATION)
        self.n = np.diff(self.offs)
        self.window = np.minimum(self.n, least)
        self.need = np.ceil(self.window * share - 1e-9).astype(np.int64)
        self.item = np.repeat(np.arange(len(rows)), self.n)
        self.masks, found = [], [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for n in np.unique(self.window[self.n > 0]).tolist():
            changes = n - int(np.ceil(n * share - 1e-9))
            own = (self.window == n) & (self.n == n) if n < least else self.window == n
            for mask in sliding(masks(n, changes)) if n == least else masks(n, changes):
                shape = mask.strip("0")
                x, p = _seeds(self.h, self.offs, shape)
                mine = own[self.item[p]]
                if n < least:  # the whole item is the window
                    mine &= p - self.offs[self.item[p]] == mask.index("1")
                found.append((x[mine], p[mine]))
                self.masks.append(shape)
        self.masks = sorted(set(self.masks))
        self.span = max(map(len, self.masks), default=1)
        hashes, at = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.at = hashes[order], at[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.hashes >> np.uint64(42)).astype(np.int64)] = True

    def matches(self, h: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and the number of the item's words that hold, for each pair of them."""
        seeds = []
        for mask in self.masks:
            x, p = _seeds(h, offs, mask)
            ok = self.maybe[(x >> np.uint64(42)).astype(np.int64)]
            x, p = x[ok], p[ok]
            lo = np.searchsorted(self.hashes, x, "left")
            seeds.append((p, lo, np.searchsorted(self.hashes, x, "right") - lo))
        # stretches of positions with at most about HITS hits, all masks together
        upto = np.cumsum(sum((np.bincount(p, m, minlength=len(h)) for p, _, m in seeds), np.zeros(len(h)))) if len(h) else np.zeros(0)
        ends = np.unique(np.append(np.searchsorted(upto, np.arange(HITS, (upto[-1] if len(h) else 0) + HITS, HITS)) + 1, len(h)))
        found, a = [np.zeros((3, 0), np.int64)], 0
        for b in ends:
            found.append(self._laid(h, offs, least, *self._hits(seeds, a, b)))
            a = b
        found = np.unique(np.concatenate(found, axis=1), axis=1)
        if not found.shape[1]:
            return found
        first = np.flatnonzero(np.concatenate([[True], (np.diff(found[:2], axis=1) != 0).any(axis=0)]))
        return np.stack([found[0, first], found[1, first], np.diff(np.concatenate([first, [found.shape[1]]]))])

    def _hits(self, seeds: list, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs of a position from a to b and a position of the items."""
        hits_p, hits_q = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p, lo, m in seeds:
            i, j = np.searchsorted(p, (a, b))
            p, lo, m = p[i:j], lo[i:j], m[i:j]
            start = np.repeat(lo - (np.cumsum(m) - m), m)
            hits_p.append(np.repeat(p, m))
            hits_q.append(self.at[np.arange(m.sum()) + start])
        pairs = np.unique(np.concatenate(hits_p) * len(self.h) + np.concatenate(hits_q))
        return pairs // max(1, len(self.h)), pairs % max(1, len(self.h))

    def _laid(self, h: np.ndarray, offs: np.ndarray, least: int, hits_p: np.ndarray, hits_q: np.ndarray) -> np.ndarray:
        """Text, item and place in the item of the words that hold around the hits."""
        text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        reach = np.arange(1 - least, self.span + least - 1)
        out = [np.zeros((3, 0), np.int64)]
        for a in range(0, len(hits_p), 1 << 15):
            p, q = hits_p[a : a + (1 << 15)], hits_q[a : a + (1 << 15)]
            d, i = text[p], self.item[q]
            pp, qq = p[:, None] + reach, q[:, None] + reach
            inside = (pp >= offs[d][:, None]) & (pp < offs[d + 1][:, None]) & (qq >= self.offs[i][:, None]) & (qq < self.offs[i + 1][:, None])
            same = inside & (h[np.where(inside, pp, 0)] == self.h[np.where(inside, qq, 0)])
            cum = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            span = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(inside, axis=1)], axis=1)
            ends = np.arange(len(reach))[None, :] + self.window[i][:, None]
            fits = ends <= len(reach)
            ends = np.minimum(ends, len(reach))
            rows = np.arange(len(p))[:, None]
            good = fits & (cum[rows, ends] - cum[:, :-1] >= self.need[i][:, None]) & (span[rows, ends] - span[:, :-1] == self.window[i][:, None])
            # a position holds if a good window that covers it began at most a window before
            ahead = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(good, axis=1)], axis=1)
            since = np.maximum(np.arange(len(reach))[None, :] - self.window[i][:, None] + 1, 0)
            held = same & (ahead[:, 1:] - ahead[rows, since] > 0)
            r, c = np.nonzero(held)
            out.append(np.unique(np.stack([d[r], i[r], qq[r, c]]), axis=1))
        return np.unique(np.concatenate(out, axis=1), axis=1)


def _blocks(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> Iterator:
    """Broadcast blocks of the benchmark, each within BLOCK_WORDS words on average of its hash."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()[0]
    n = max(1, -(-size // BLOCK_WORDS))
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        if rows:
            yield spark.sparkContext.broadcast(Items([tuple(r) for r in rows], least, share))


def _find(block, least: int, text: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = block.value
        for batch in batches:
            buf, offs = utf8(batch.column(batch.schema.get_field_index(text)))
            ok = np.ones(batch.num_rows, bool)
            for a, b in slices(offs):
                h, _, woffs = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a], PUNCTUATION)
                d, i, k = items.matches(h, woffs, least)
                ok[a + d] = False
                if not keep and len(d):
                    yield pa.record_batch({"doc_id": batch.column(0).take(pa.array(a + d)), "item_id": pa.array(items.ids[i]), "matched": pa.array(k), "item_words": pa.array(items.n[i])})
            if keep:
                yield batch.filter(pa.array(ok))

    return run


def find(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """doc_id, item_id, matched (words of the item found), item_words: each leaked pair."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, matched long, item_words long"
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(docs, benchmark, least, share):
        out = out.unionByName(texts.mapInArrow(_find(block, least, "text", False), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: int = 13, share: float = 0.8) -> DataFrame:
    """The documents, all their columns, without those that leak an item."""
    for block in _blocks(docs, benchmark, least, share):
        docs = docs.mapInArrow(_find(block, least, "text", True), docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    """op7: pairs of a document and a benchmark item that it holds."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
