"""Exact-substring dedup by longest-previous-factor arrays over suffix-ordered shards.

A byte goes if it lies in a string of SPAN bytes that also starts earlier: in a document of smaller
doc_id, or earlier in the same one. Strings never cross documents and are judged on the input.

1. Anchors. In each string of SPAN bytes the GRAM-byte gram of least hash (the first of equals) is
   its anchor, so equal strings have equal anchors at the same place, and one byte in about 35
   starts an anchor. An anchor's context is all that strings holding it can reach.
2. Anchors meet by the gram's hash. If an earlier anchor has the same whole context, the context is
   a later copy and goes as a whole; tasks see to that for their own rows before the shuffle, so a
   passage that most documents share sends few rows. A gram with one context only is done. What is left are the first rows of each
   of several contexts of a gram: the edges of repeated passages.
3. Their contexts are fetched from the texts, once for rows that repeat a text, and each gram is a shard:
   the suffixes of its contexts whose first SPAN bytes come up again there, by hash, are put in suffix order, with their
   common prefixes. The previous and the next smaller place of a suffix in that order give its longest previous factor;
   where that is SPAN or more, the string goes. Grams with more than HOT contexts are not put into one task:
   their contexts' strings are halved, and each half's contexts meet by the bytes that all its strings share, which
   tells more of them apart; equal halves but the first go as a whole, and what still shares bytes with too
   many others is halved again, down to single strings at most.
4. The documents' removed stretches are united and cut from the texts.

Null text counts as empty. Null doc_id: nothing is removed there, and it removes nothing. Rows that
repeat a doc_id are at the same place, so equal strings at one start remove nothing of each other;
stretches are told by doc_id and the text's hash, so each of its texts is cut by its own. Further
columns are not read; an empty table gives an empty result. Very long texts are read in pieces that overlap by a string less a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import _BYTE, _powers, cut, gathered, mix, prefix_sums, signed, slices, utf8

SPAN, GRAM = 100, 32
#: Bytes of a context on either side of its gram.
SIDE = SPAN - GRAM
#: Contexts of a gram that are put in suffix order together.
HOT = 4096
PIECE = 1 << 19

_TABLES: list[np.ndarray] = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        base = 0xD6E8FEB86659FD93
        _TABLES.extend([_powers((1 << 20) + 1, base), _powers((1 << 20) + 1, pow(base, -1, 1 << 64))])
    return _TABLES[0], _TABLES[1]


class Hashes:
    """Hashes of any stretch of a buffer of less than 2**20 bytes."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _tables()
        self.sums = prefix_sums(_BYTE[buf] * up[: len(buf)])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, place in it, bytes of context on the left and right, gram hash and context hash."""
    n = len(buf)
    text = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    starts = np.flatnonzero(text[: n - SPAN + 1] == text[SPAN - 1 :]) if n >= SPAN else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    hashes = Hashes(buf)
    at = np.arange(n - GRAM + 1)
    gram = hashes.of(at, at + GRAM)
    least = (gram & np.uint64(0xFFFFFFFFFFF00000)) | at.astype(np.uint64)
    wide, width = SIDE + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    at = np.unique((least[starts] & np.uint64(0xFFFFF)).astype(np.int64))
    t = text[at]
    left, right = np.minimum(SIDE, at - offs[t]), np.minimum(SIDE, offs[t + 1] - at - GRAM)
    context = mix(hashes.of(at - left, at + GRAM + right) + (left * 256 + right).astype(np.uint64))
    return t, at - offs[t], left, right, gram[at], context


def _pieces(offs: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Rows a to b and, of a text that is longer than a piece, its bytes from and to."""
    for a, b in slices(offs, PIECE):
        size = int(offs[b] - offs[a])
        if size <= PIECE:
            yield a, b, 0, size
        else:
            for x in range(0, size - SPAN + 1, PIECE):
                yield a, b, x, min(size, x + PIECE + SPAN - 1)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = utf8(batch.column(1))
        ids, texts = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        found = []
        for a, b, x, y in _pieces(offs):
            own = np.array([0, y - x]) if x or y < offs[b] - offs[a] else offs[a : b + 1] - offs[a]
            t, at, left, right, g, f = anchors(buf[offs[a] + x : offs[a] + y], own)
            found.append((ids[a + t], texts[a + t], at + x, left * 256 + right, g, f))
        if not found:
            continue
        doc, text, at, sides, g, f = (np.concatenate(c) for c in zip(*found, strict=True))
        # of equal contexts in this batch only the earliest goes on; later ones are copies
        order = np.lexsort((at, doc, f, g))
        doc, text, at, sides, g, f = doc[order], text[order], at[order], sides[order], g[order], f[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (f[1:] != f[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(g) else np.zeros(0, np.int64)
        copy = (doc != doc[first]) | (at != at[first])
        # a copy needs no meeting: its key is its own
        g = np.where(copy, mix(f + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), g)
        back = np.lexsort((f, g, text, at, doc))
        # of equal rows of a document two go on, which tell that there are several
        same = np.zeros(len(g), bool)
        same[2:] = np.logical_and.reduce([c[back[2:]] == c[back[:-2]] for c in (doc, at, text, g, f)])
        back = back[~same]
        yield pa.record_batch({"g": signed(g[back]), "f": signed(f[back]), "doc_id": pa.array(doc[back]), "t": pa.array(text[back]), "at": pa.array(at[back].astype(np.int32)), "sides": pa.array(sides[back].astype(np.int32)), "copy": pa.array(copy[back])})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, text, asked (structs of g, at, sides, hot), t and whether such rows repeat: of
    these a task reads one of each doc_id and t."""
    read: set[tuple[int, int]] = set()
    for batch in batches:
        again = batch.column(4).to_numpy(zero_copy_only=False)
        if again.any():
            fresh = ~again
            for i in np.flatnonzero(again):
                key = (batch.column(0)[i].as_py(), batch.column(3)[i].as_py())
                fresh[i] = key not in read
                read.add(key)
            batch = batch.filter(pa.array(fresh))
        buf, offs = utf8(batch.column(1))
        asked = batch.column(2)
        flat, counts = asked.flatten(), np.diff(np.asarray(asked.offsets))
        row = np.repeat(np.arange(batch.num_rows), counts)
        at, sides = np.asarray(flat.field("at")).astype(np.int64), np.asarray(flat.field("sides")).astype(np.int64)
        a, b = offs[row] + at - sides // 256, offs[row] + at + GRAM + sides % 256
        for i in range(0, len(row), 8192):
            j = min(len(row), i + 8192)
            size = b[i:j] - a[i:j]
            index = np.arange(size.sum()) + np.repeat(a[i:j] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            data = buf[index]
            ctx = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data)])
            yield pa.record_batch({"g": flat.field("g").slice(i, j - i), "doc_id": batch.column(0).take(pa.array(row[i:j])), "t": batch.column(3).take(pa.array(row[i:j])), "start": pa.array(at[i:j] - sides[i:j] // 256), "at": pa.array(at[i:j]), "hot": flat.field("hot").slice(i, j - i), "context": ctx})


def _shared_strings(group: np.ndarray, buf: np.ndarray, offs: np.ndarray, least: int) -> np.ndarray:
    """Places in buf whose next `least` bytes are inside of a context and, by hash, come up again in the group."""
    places, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in slices(offs, 1 << 19):
        at = gathered(offs[i:j], np.maximum(0, np.diff(offs[i : j + 1]) - least + 1))
        own = np.repeat(group[i:j], np.maximum(0, np.diff(offs[i : j + 1]) - least + 1))
        base = at - offs[i]
        places.append(at)
        keys.append(mix(Hashes(buf[offs[i] : offs[j]]).of(base, base + least) ^ mix(own.astype(np.uint64))))
    at, key = np.concatenate(places), np.concatenate(keys)
    ordered = np.sort(key)
    twice = np.append(ordered[1:][ordered[1:] == ordered[:-1]], np.uint64(0))
    twice.sort()
    return at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]


def suffix_order(group: np.ndarray, buf: np.ndarray, offs: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at s, by group and then in suffix order, and the common prefix of each
    with the one before it (0 for the first of a group). A suffix ends with its context."""
    r = np.searchsorted(offs, s, "right") - 1
    left = offs[r + 1] - s
    wide = int(left.max(initial=1))
    padded = np.concatenate([buf, np.zeros(wide, np.uint8)])
    suffix = np.lib.stride_tricks.sliding_window_view(padded, wide)[s]
    suffix[np.arange(wide) >= left[:, None]] = 0
    order = np.lexsort((left, suffix.view(f"S{wide}")[:, 0], group[r]))  # padding sorts first, a shorter one before its own zeros
    s, suffix, left, group = s[order], suffix[order], left[order], group[r[order]]
    common = np.zeros(len(s), np.int32)
    for i in range(1, len(s), 1 << 16):
        j = min(len(s), i + (1 << 16))
        apart = suffix[i:j] != suffix[i - 1 : j - 1]
        most = np.minimum(left[i:j], left[i - 1 : j - 1])
        alike = np.minimum(np.where(apart.any(axis=1), apart.argmax(axis=1), wide), most)
        common[i:j] = np.where(group[i:j] == group[i - 1 : j - 1], alike, 0)
    return s, common


def _with_smaller_before(place: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix, in suffix order, with the previous smaller one: the nearest before it of smaller
    `place`. 0 where there is none, or where less than `least` is shared on the way.

    Least places and prefixes over 1, 2, 4, ... suffixes are kept, so all are searched at once, in as
    many steps as the longest run of suffixes sharing `least` bytes has binary digits."""
    m = len(place)
    i = np.arange(m)
    first = np.maximum.accumulate(np.where(common < least, i, 0)) if m else i
    smallest, shared = [place], [common]
    while 1 << len(smallest) <= (i - first).max(initial=0):
        step, p, c = 1 << len(smallest) - 1, smallest[-1].copy(), shared[-1].copy()
        p[step:] = np.minimum(p[step:], smallest[-1][:-step])
        c[step:] = np.minimum(c[step:], shared[-1][:-step])
        smallest.append(p)
        shared.append(c)
    at, out = i - 1, common.copy()
    for k in range(len(smallest) - 1, -1, -1):
        over = np.flatnonzero(at - (1 << k) + 1 >= first)
        over = over[smallest[k][at[over]] >= place[over]]
        out[over] = np.minimum(out[over], shared[k][at[over]])
        at[over] -= 1 << k
    out[at < first] = 0
    return out


def longest_previous_factors(group: np.ndarray, doc: np.ndarray, start: np.ndarray, buf: np.ndarray, offs: np.ndarray, least: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Places in buf, and the longest previous factor of each: the most bytes from there on to its context's end
    that also start at a smaller place of its group (0 if fewer than `least`). Places whose next `least` bytes
    do not come up again in their group, by hash, have none and are left out before the sort.

    Place in the corpus is doc, then start + place in the context. The longest earlier match of a suffix is
    with its previous or its next smaller place in suffix order."""
    s, common = suffix_order(group, buf, offs, _shared_strings(group, buf, offs, least))
    r = np.searchsorted(offs, s, "right") - 1
    by = start[r] + s - offs[r]
    order = np.lexsort((by, doc[r]))
    new = np.zeros(len(s), np.int32)
    new[1:] = (doc[r[order[1:]]] != doc[r[order[:-1]]]) | (by[order[1:]] != by[order[:-1]])
    place = np.empty(len(s), np.int32)
    place[order] = np.cumsum(new)
    after = np.append(common[1:], np.int32(0))[: len(s)]  # with the one after it
    factor = np.maximum(_with_smaller_before(place, common, least), _with_smaller_before(place[::-1], after[::-1], least)[::-1])
    return s, factor


def previous_factors(group: np.ndarray, doc: np.ndarray, start: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context and place in it of each string whose longest previous factor in its group is SPAN or more."""
    s, factor = longest_previous_factors(group, doc, start, buf, offs)
    s = s[factor >= SPAN]
    r = np.searchsorted(offs, s, "right") - 1
    return r, s - offs[r]


def _stretches(doc: np.ndarray, text: np.ndarray, r: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Strings from `place` on in rows r, united where they follow each other."""
    order = np.lexsort((place, r))
    r, place = r[order], place[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (place[1:] != place[:-1] + 1)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(r)) - 1 if len(r) else a
    return pa.record_batch({"doc_id": pa.array(doc[r[a]]), "t": pa.array(text[r[a]]), "a": pa.array(place[a].astype(np.int64)), "b": pa.array((place[b] + SPAN).astype(np.int64))})


def _suffix_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by g; a group is worked on when its last row is there."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        buf, offs = utf8(table["context"].combine_chunks() if table["context"].num_chunks != 1 else table["context"].chunk(0))
        g, doc, text, start = (table[c].to_numpy() for c in ("g", "doc_id", "t", "start"))
        r, place = previous_factors(g, doc, start, buf, offs)
        return _stretches(doc, text, r, place + start[r])

    rows = 0
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            held.append(batch.slice(i, 4096))
            rows += held[-1].num_rows
            g = held[-1].column(0).to_numpy()
            if rows >= 4096 and len(g):
                table = pa.Table.from_batches(held)
                g = table["g"].to_numpy()
                end = int(np.searchsorted(g, g[-1], "left"))  # the last group may go on
                if end:
                    yield work(table.slice(0, end))
                    held = table.slice(end).to_batches()
                    rows = len(g) - end
    if rows:
        yield work(pa.Table.from_batches(held))


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id, start, context, at (the anchor's place), lo, hi and t, each as two: strings that
    begin lo to hi bytes before the anchor are dealt into the nearer and the farther half of that
    range, with the bytes that they reach. g is the hash of the bytes that a half's strings share."""
    for batch in batches:
        buf, offs = utf8(batch.column(2))
        ids = batch.column(0).to_numpy()
        start, at, lo, hi = (batch.column(k).to_numpy().astype(np.int64) for k in (1, 3, 4, 5))
        for i, j in slices(offs, 1 << 18):
            mid = (lo[i:j] + hi[i:j]) // 2
            row = np.tile(np.arange(j - i), 2)
            low, high = np.concatenate([lo[i:j], mid + 1]), np.concatenate([mid, hi[i:j]])
            anchor = (at - start)[i:j][row]
            size = np.diff(offs[i : j + 1])[row]
            near, far = np.maximum(low, anchor + SPAN - size), np.minimum(high, anchor)  # strings inside of the context
            ok = (near <= far) & (low <= high)
            row, low, high, near, far, anchor = (x[ok] for x in (row, low, high, near, far, anchor))
            base = offs[i:j][row] - offs[i] + anchor
            hashes = Hashes(buf[offs[i] : offs[j]])
            a, b = base - far, base - near + SPAN
            part = pa.array([buf[offs[i] + x : offs[i] + y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
            shared = mix(hashes.of(base - low, base - high + SPAN) + (low * 256 + high).astype(np.uint64))
            whole = mix(hashes.of(a, b) + (near * 256 + far).astype(np.uint64))
            yield pa.record_batch({"g": signed(shared), "f": signed(whole), "doc_id": pa.array(ids[i + row]), "t": batch.column(6).take(pa.array(i + row)), "start": pa.array(at[i + row] - far), "at": pa.array(at[i + row]), "lo": pa.array(low), "hi": pa.array(high), "context": part})


def copied(docs: DataFrame) -> DataFrame:
    """doc_id, t (hash of the text), a, b: stretches of bytes, maybe overlapping, that go."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    docs = docs.withColumn("t", F.xxhash64("text"))
    rows = docs.mapInArrow(_anchor_rows, "g long, f long, doc_id long, t long, at int, sides int, copy boolean").repartition("g")
    within = Window.partitionBy("g", "f").orderBy("doc_id", "at")
    rows = rows.withColumn("nth", F.row_number().over(within)).withColumn("rank", F.rank().over(within))
    rows = rows.withColumn("kinds", F.sum((F.col("nth") == 1).cast("int")).over(Window.partitionBy("g")))
    later = F.col("copy") | (F.col("rank") > 1)
    met = cut(rows.where(later | (F.col("kinds") > 1)).select("g", "doc_id", "t", "at", "sides", later.alias("later"), (F.col("kinds") > HOT).alias("hot")))

    left, right = F.floor(F.col("sides") / 256).cast("long"), (F.col("sides") % 256).cast("long")
    whole = met.where("later").select("doc_id", "t", (F.col("at") - left).alias("a"), (F.col("at") + GRAM + right).alias("b"))

    asked = met.where("not later").groupBy("doc_id", "t", "g", "at", "sides", "hot").agg(F.count("*").alias("rows"))
    asked = asked.groupBy("doc_id", "t").agg(F.collect_list(F.struct("g", "at", "sides", "hot")).alias("asked"), (F.max("rows") > 1).alias("again"))
    contexts = docs.join(asked, ["doc_id", "t"]).select("doc_id", "text", "asked", "t", "again").mapInArrow(_contexts, "g long, doc_id long, t long, start long, at long, hot boolean, context binary")
    contexts = cut(contexts)
    found = whole.unionByName(_in_order(contexts.where("not hot")))
    columns = ["doc_id", "start", "context", "at", "lo", "hi", "t"]
    hot = contexts.where("hot").withColumns({"lo": F.lit(0).cast("long"), "hi": F.lit(SIDE).cast("long")}).select(*columns)
    place = F.struct("doc_id", "start")
    while hot.take(1):
        parts = cut(hot.mapInArrow(_halves, "g long, f long, doc_id long, t long, start long, at long, lo long, hi long, context binary"))
        firsts = cut(parts.groupBy("g", "f").agg(F.min(place).alias("first")))
        kinds = firsts.groupBy("g").agg(F.count("*").alias("kinds"))
        parts = cut(parts.join(firsts, ["g", "f"]).join(kinds, "g").withColumn("later", place > F.col("first")).where("later or kinds > 1"))
        later = parts.where("later").select("doc_id", "t", F.col("start").alias("a"), (F.col("start") + F.length("context")).alias("b"))
        rest = parts.where("not later").withColumn("hot", F.col("kinds") > HOT)
        found = found.unionByName(later).unionByName(_in_order(rest.where("not hot")))
        hot = rest.where("hot").select(*columns)
    return found


def _in_order(contexts: DataFrame) -> DataFrame:
    shards = contexts.select("g", "doc_id", "t", "start", "context").repartition("g").sortWithinPartitions("g")
    return shards.mapInArrow(_suffix_order, "doc_id long, t long, a long, b long")


def _removal(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            gone = batch.column(2).to_pylist()
            out: list[tuple] = []
            for i, stretches in enumerate(gone):
                data = buf[offs[i] : offs[i + 1]]
                spans: list[list[int]] = []
                for x in sorted((s["a"], s["b"]) for s in stretches or ()):
                    if spans and x[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], x[1])
                    else:
                        spans.append(list(x))
                ok = np.ones(len(data), bool)
                for a, b in spans:
                    ok[a:b] = False
                left = data[ok].tobytes() if spans else data.tobytes()
                out.append((len(data), len(data) - len(left), len(spans), left if keep else hashlib.sha256(left).hexdigest()))
            names = ("n_bytes", "n_removed", "n_spans", "kept" if keep else "kept_sha256")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary() if keep else pa.string())
            yield pa.record_batch({"doc_id": batch.column(0)} | {n: pa.array(c, k) for n, c, k in zip(names, zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)})

    return run


def _joined(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = copied(docs).groupBy(F.col("doc_id").alias("of"), "t").agg(F.collect_set(F.struct("a", "b")).alias("gone"))
    return docs.join(gone, (docs["doc_id"] == gone["of"]) & (F.xxhash64("text") == gone["t"]), "left").select("doc_id", "text", "gone")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the bytes that are left (a cut may fall inside of
    a character, so they are bytes, not a string)."""
    return _joined(docs).mapInArrow(_removal(True), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what goes of each document, and the hash of what is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _joined(docs).mapInArrow(_removal(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
