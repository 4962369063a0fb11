"""Packing documents into sequences of bounded length by the linear grouping scheme, then best fit.

A document is its tokenizer ids and an end id; only documents longer than a sequence are cut, into
full pieces and a last one. All that packing needs to know of the corpus is how many pieces have each
length, so it is planned on that histogram (at most `capacity` numbers), whatever the corpus's size:

1. Large lengths (over a share of the capacity) in descending order are cut into groups of equally
   many pieces, each rounded up to its greatest length.
2. Configurations of these few sizes are optimised by column generation: a linear programme whose
   columns come from a knapsack under its prices. Each is used as often as its share, rounded down.
3. Pieces of a group take its slots, longest first. Where their lengths change, a configuration
   splits into runs of sequences that hold equal lengths; a run knows what is left in its sequences.
4. Large pieces left over, then small ones, longest first, go where they leave least; what fits
   nowhere opens sequences. Several numbers of groups and bounds of large are tried; the fewest
   sequences win.

Each piece's place among those of its length follows from its place in its task and the tasks before
(sums by length and task), and the plan's runs (a bounded table) tell its sequence and offset. No
length, document or run of equal pieces meets in one task.

Words are tokenized once and kept for further texts (a bounded table; equal 64-bit hashes within a
worker count as equal words): ids do not depend on what stands beyond white space, nor across the
edge of ASCII letters or digits and punctuation other than ' and |, which contractions and special
tokens hold. That is so for the tokenizer of the query, whose words end at these edges.

Null and empty texts are one piece that holds the end id. Null doc_ids and rows that repeat a doc_id
are documents each. Texts of any length are tokenized in regions cut at white space; the ids of one
document are held at once. An empty table gives an empty result. Columns other than doc_id and text
are not read. A rerun gives each piece the same ids; which of equally long pieces shares a sequence
with which may change with the partitioning of the input.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import _SPACE, cut, drop_cut, gathered, regions, run_hashes, utf8

#: Bytes of text that are tokenized at once, and words that a task keeps.
REGION, KEPT = 1 << 20, 1 << 21
#: What a plan tries: the number of groups, and the share of a sequence from which a length is large.
TRIES = ((96, 1 / 4), (96, 1 / 3), (192, 1 / 2))

_KIND = np.zeros(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 2


# ---------------------------------------------------------------- the plan, on a histogram


def best_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The numbers of each size that fit into a sequence and have the greatest total price."""
    best, marks = np.zeros(capacity + 1), []
    for g, (size, price) in enumerate(zip(sizes.tolist(), prices.tolist(), strict=True)):
        if price <= 0:
            continue
        for _ in range(capacity // size):
            more = best.copy()
            np.maximum(best[size:], best[:-size] + price, out=more[size:])
            mark = more > best + 1e-12
            if not mark.any():
                break
            marks.append((g, mark))
            best = more
    pattern, left = np.zeros(len(sizes), np.int64), capacity
    for g, mark in reversed(marks):
        if mark[left]:
            pattern[g] += 1
            left -= int(sizes[g])
    return float(best[capacity]), pattern


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used at the optimum of the linear programme."""
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    used = inverse @ need
    for turn in range(40 * n + 100):
        value, pattern = best_pattern(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        way = inverse @ pattern
        ahead = np.flatnonzero(way > 1e-9)
        if not len(ahead):
            break
        out = int(ahead[np.argmin(used[ahead] / way[ahead])])
        basis[:, out] = pattern
        if turn % 40 == 39:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / way[out]
            inverse -= np.outer(way, row)
            inverse[out] = row
        used = np.maximum(inverse @ need, 0)
    return np.rint(basis).astype(np.int64), used


class Run:
    """Equal sequences: how many, what each holds as [length, how often], and what is left in each."""

    def __init__(self, count: int, held: list[tuple[int, int]], left: int):
        self.count, self.held, self.left = count, held, left

    def part(self, count: int) -> Run:
        self.count -= count
        return Run(count, list(self.held), self.left)


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, descending, in groups of equally many pieces: (length, how many) of each group."""
    total, out, at = int(counts.sum()), [], 0
    edges = [total * (g + 1) // groups for g in range(groups)]
    now: list[tuple[int, int]] = []
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        while n:
            while edges and edges[0] <= at:
                edges.pop(0)
                if now:
                    out.append(now)
                    now = []
            m = min(n, edges[0] - at)
            now.append((length, m))
            at, n = at + m, n - m
    if now:
        out.append(now)
    merged: list[list[tuple[int, int]]] = []
    for g in out:  # groups with the same greatest length are one size
        if merged and merged[-1][0][0] == g[0][0]:
            merged[-1] += g
        else:
            merged.append(g)
    return merged


def large_runs(counts: np.ndarray, capacity: int, groups: int, least: int) -> list[Run]:
    """Runs of the optimised configurations of lengths from `least` on, with pieces in them; counts loses these."""
    lengths = np.arange(capacity - 1, least - 1, -1)
    lengths = lengths[counts[lengths] > 0]
    if not len(lengths):
        return []
    held = grouped(lengths, counts[lengths], groups)
    sizes, need = np.array([g[0][0] for g in held]), np.array([sum(n for _, n in g) for g in held], float)
    patterns, used = configurations(sizes, need, capacity)
    runs = []
    for column, count in zip(patterns.T, np.floor(used + 1e-6).astype(np.int64).tolist(), strict=True):
        slots = [g for g, n in enumerate(column.tolist()) for _ in range(n)]
        count = min([count, *(sum(n for _, n in held[g]) // int(column[g]) for g in set(slots))])
        if count <= 0:
            continue
        taken = []  # of each slot, (length, how many) in order over the configuration's sequences
        for g in slots:
            due, mine = count, []
            while due:
                length, n = held[g][0]
                m = min(n, due)
                mine.append([length, m])
                due -= m
                held[g][:1] = [(length, n - m)] if n > m else []
            taken.append(mine)
        while count:
            m = min(t[0][1] for t in taken)
            by = defaultdict(int)
            for t in taken:
                by[t[0][0]] += 1
                t[0][1] -= m
                if not t[0][1]:
                    t.pop(0)
            runs.append(Run(m, sorted(by.items(), reverse=True), capacity - sum(a * b for a, b in by.items())))
            count -= m
    for run in runs:
        for length, n in run.held:
            counts[length] -= n * run.count
    return runs


def best_fit(runs: list[Run], counts: np.ndarray, capacity: int) -> list[Run]:
    """The pieces counted, longest first, each where it leaves least; new sequences for the rest."""
    by_left: list[list[Run]] = [[] for _ in range(capacity + 1)]
    done = []
    for run in runs:
        by_left[run.left].append(run)
    for length in range(capacity, 0, -1):
        n = int(counts[length])
        left = length
        while n:
            while left <= capacity and not by_left[left]:
                left += 1
            if left > capacity:
                by_left[capacity].append(Run(-(-n // (capacity // length)), [], capacity))
                left = capacity
            run = by_left[left].pop()
            times = left // length
            whole = min(run.count, n // times)
            for count, copies in ((whole, times), (min(1, run.count - whole), n - whole * times)):
                if count and copies and n:
                    part = run.part(count)
                    part.held.append((length, copies))
                    part.left -= length * copies
                    (by_left[part.left] if part.left else done).append(part)
                    n -= count * copies
            if run.count:
                by_left[left].append(run)
    return done + [run for same in by_left for run in same if run.held]


def plan(counts: np.ndarray, capacity: int, tries: tuple[tuple[int, float], ...] = TRIES) -> list[Run]:
    """Runs of sequences that hold counts[length] pieces of each length from 1 to capacity."""
    best = None
    for groups, large in tries:
        left = counts.astype(np.int64).copy()
        runs = best_fit(large_runs(left, capacity, groups, max(1, int(capacity * large) + 1)), left, capacity)
        if best is None or sum(r.count for r in runs) < sum(r.count for r in best):
            best = runs
    return best or []


def places(runs: list[Run], counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Arrays, by ascending first place of a slot among all pieces in order of length: that place, the
    run's first sequence, copies of the length in each sequence, the first copy's offset, the length."""
    start = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, copies in run.held:
            rows.append((int(start[length]), sequence, copies, offset, length))
            start[length] += run.count * copies
            offset += length * copies
        sequence += run.count
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5


# ---------------------------------------------------------------- tokens

_TOKENS: dict[str, Tokens] = {}


class Tokens:
    """Ids of texts by a tokenizer's file, with a bounded table of known words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.tables, self.flat, self.filled = [none, none], np.zeros(1 << 16, "<u4"), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of these words begin in `flat`, -1 where they are not known, and how many there are."""
        at, n = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for keys, starts, sizes in self.tables:
            if len(keys):
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                at[hit], n[hit] = starts[i[hit]], sizes[i[hit]]
        return at, n

    def learn(self, h: np.ndarray, words: list[bytes]) -> None:
        for a in range(0, len(words), 4096):  # as one text: a call a word costs twice as much
            text = [w.decode("utf-8", "replace") for w in words[a : a + 4096]]
            edges = np.cumsum([0, *(len(w) + 1 for w in text)])
            found = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
            word = np.searchsorted(edges, np.array([x[0] for x in found.offsets], np.int64), "right") - 1
            upto, ids = np.searchsorted(word, np.arange(len(text) + 1)), np.array(found.ids, "<u4")
            if self.filled + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) + len(ids), "<u4")])
            self.flat[self.filled : self.filled + len(ids)] = ids
            new = h[a : a + 4096], upto[:-1] + self.filled, np.diff(upto)
            self.filled += len(ids)
            self.tables[1] = tuple(np.concatenate(x) for x in zip(self.tables[1], new, strict=True))
        order = np.argsort(self.tables[1][0], kind="stable")
        self.tables[1] = tuple(x[order] for x in self.tables[1])
        if len(order) > KEPT // 32:  # the smaller table joins the larger one now and then
            both = [np.concatenate(x) for x in zip(*self.tables, strict=True)]
            order = np.argsort(both[0], kind="stable")
            self.tables = [tuple(x[order] for x in both), tuple(x[:0] for x in both)]

    def words(self, buf: bytes, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each has."""
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        at, n = self.find(keys)
        new = np.flatnonzero(at < 0)
        if len(new):
            if sum(len(t[0]) for t in self.tables) + len(new) > KEPT:
                self.clear()
                new = np.arange(len(keys))
            which = first[new]
            self.learn(keys[new], [buf[i:j] for i, j in zip(starts[which].tolist(), ends[which].tolist(), strict=True)])
            at, n = self.find(keys)
        return self.flat[gathered(at[back], n[back])], n[back]

    def texts(self, col: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn."""
        buf, offs = utf8(col)
        row, held = 0, []
        while row < len(offs) - 1 and offs[row + 1] == 0:
            yield np.zeros(0, "<u4")
            row += 1
        for a, b in regions(buf, offs, _SPACE, REGION):
            piece = buf[a:b]
            word, kind = ~_SPACE[piece], _KIND[piece]
            inner = offs[(offs > a) & (offs < b)] - a
            edge = np.ones(len(piece) + 1, bool)
            edge[1:-1] = (word[1:] != word[:-1]) | (kind[1:] + kind[:-1] == 3)
            edge[inner] = True
            starts = np.flatnonzero(edge[:-1] & word)
            edges = np.flatnonzero(edge)
            ends = edges[np.searchsorted(edges, starts, "right")]
            ids, each = self.words(piece.tobytes(), starts, ends, run_hashes(piece, starts, ends))
            upto = np.concatenate([[0], np.cumsum(each)])
            stops = offs[(offs > a) & (offs <= b)] - a
            last = 0
            for stop in upto[np.searchsorted(starts, stops)].tolist():
                yield np.concatenate([*held, ids[last:stop]]) if held else ids[last:stop]
                held, last, row = [], stop, row + 1
            if last < len(ids):
                held.append(ids[last:])


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and nth (place among the task's pieces of this
    length) of each piece; with `ids`, its ids too (little-endian, 32 bits each)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, task int, nth long" + ", ids binary" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:  # the words stay for the next task of this worker
            _TOKENS.clear()
            _TOKENS[path] = Tokens(path)
        tokens, task, seen = _TOKENS[path], TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        stop = np.array([end], "<u4")
        for batch in batches:
            rows, numbers, data = [], [], []
            for row, text in enumerate(tokens.texts(batch.column("text"))):
                text = np.concatenate([text, stop])
                for piece, at in enumerate(range(0, len(text), capacity)):
                    part = text[at : at + capacity].tobytes()
                    length = len(part) // 4
                    rows.append(row)
                    numbers.append((piece, at, length, zlib.crc32(part), seen[length]))
                    seen[length] += 1
                    if ids:
                        data.append(part)
            n = np.array(numbers, np.int64).reshape(-1, 5)
            cols = [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(n[:, i], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64()))), pa.array(np.full(len(n), task), pa.int32()), pa.array(n[:, 4])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(data, pa.binary())] * ids, [c.split()[0] for c in schema.split(", ")])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def packed(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (and its ids)."""
    table = cut(pieces(docs, path, capacity, end, ids))
    by_task = cut(table.groupBy("length", "task").agg(F.count("*").alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        counts[r.length] = r.n
    slots = places(plan(counts, capacity), counts)
    first = (np.cumsum(counts) - counts).tolist()
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_task = by_task.select("length", "task", before.alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo, sequence, copies, offset, size = slots
        base = np.array(first)
        for batch in batches:
            length = batch.column("length").to_numpy()
            place = base[length] + batch.column("before").to_numpy() + batch.column("nth").to_numpy()
            slot = np.searchsorted(lo, place, "right") - 1
            turn = place - lo[slot]
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start")} | {"length": pa.array(length.astype(np.int64)), "ids_crc32": batch.column("ids_crc32")}
            out |= {"sequence_id": pa.array(sequence[slot] + turn // copies[slot]), "offset": pa.array(offset[slot] + turn % copies[slot] * size[slot])}
            yield pa.RecordBatch.from_pydict(out | ({"ids": batch.column("ids")} if ids else {}))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids binary" * ids
    out = cut(table.join(by_task, ["length", "task"]).mapInArrow(run, schema))
    drop_cut(table)
    return out


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed(..., ids=True): bounded groups of bounded pieces."""
    held = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(held, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return placed.groupBy("sequence_id").agg(joined.alias("ids"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the place of each piece of each document."""
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
