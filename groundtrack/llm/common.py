"""What the corpus operators share: shared-storage cuts and components of the library, Arrow text access and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.operators.components import components, cut, drop_cut, shared_dir  # noqa: F401

#: Text bytes handled at once inside a task; bounds the size of the numpy temporaries.
SLICE_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15)


def fresh(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to clash with no column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """The rows that no model may learn from: crc32 of the id's text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def share_of(key: Column, share: float, seed: int) -> Column:
    """A reproducible Bernoulli sample of rows by a hash of their key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))


def unseen(keys: pa.Array, seen: set[int]) -> np.ndarray:
    """The rows whose key has not come up in this task; their keys join `seen`, which holds sampled keys only."""
    keys, out = keys.to_pylist(), []
    for i, key in enumerate(keys):
        if key not in seen:
            seen.add(key)
            out.append(i)
    return np.array(out, np.int64)


def few(rows: DataFrame, most: int) -> DataFrame:
    """One row of each `key`, and the `most` with the least keys: a sample that a driver may hold, whatever repeats."""
    return rows.dropDuplicates(["key"]).orderBy("key").limit(most)


# ---------------------------------------------------------------- text in Arrow batches


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column as one array, and the n + 1 offsets of its rows; null is empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, at least one row in each."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of a hash may be used."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte but letters and digits, as separators of words without punctuation.
PUNCTUATION = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    p = np.full(max(n, 1), base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def _piece_words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and its first byte, for texts that follow each other in buf."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~gap[buf]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[offs[:-1][offs[:-1] < len(buf)]] = False
    first = word & ~before
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), at
    inside = np.arange(len(buf)) - at[np.maximum(np.cumsum(first) - 1, 0)]
    inside[~word] = 0
    each = _BYTE[_LOWER[buf]] * _powers(int(inside.max()) + 1)[np.maximum(inside, 0)]
    each[~word] = 0
    return mix(np.add.reduceat(each, at)), at


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case.

    Returns the 64-bit hash of each word, its first byte in buf, and the n + 1 offsets of texts in
    these. A text longer than a few slices is hashed in pieces cut at white space.
    """
    if len(buf) <= 4 * SLICE_BYTES:
        h, at = _piece_words(buf, offs, gap)
    else:
        hs, ats, a = [], [], 0
        while a < len(buf):
            b = min(len(buf), a + SLICE_BYTES)
            while b < len(buf) and not gap[buf[b]]:
                b += 1
            inner = offs[(offs > a) & (offs < b)] - a
            h, at = _piece_words(buf[a:b], np.concatenate([[0], inner, [b - a]]), gap)
            hs.append(h)
            ats.append(at + a)
            a = b
        h, at = np.concatenate(hs), np.concatenate(ats)
    return h, at, np.searchsorted(at, offs)


def regions(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `size` bytes that end where a text does or, in a longer text, before a gap."""
    a = 0
    while a < len(buf):
        b = int(offs[max(0, int(np.searchsorted(offs, a + size, "right")) - 1)])
        if b <= a:
            end, b = int(offs[np.searchsorted(offs, a, "right")]), a + size
            while b < end:
                at = np.flatnonzero(gap[buf[b : min(end, b + SLICE_BYTES)]])
                if len(at):
                    b += int(at[0])
                    break
                b += SLICE_BYTES
            b = min(b, end)
        yield a, b
        a = b


def run_hashes(buf: np.ndarray, at: np.ndarray, end: np.ndarray, fold: np.ndarray | None = None, block: int = 0) -> np.ndarray:
    """64-bit hash of the bytes at to end of each run, folded by a table, in blocks: a run may be longer than one."""
    block = block or SLICE_BYTES
    powers, out = _powers(block + 1), np.zeros(len(at), np.uint64)
    table = _BYTE if fold is None else _BYTE[fold]
    upto = np.concatenate([[0], np.cumsum(end - at)])
    i = 0
    while i < len(at):
        j = int(np.searchsorted(upto, upto[i] + block, "right")) - 1
        if j <= i:
            power = np.uint64(1)
            with np.errstate(over="ignore"):
                for a in range(int(at[i]), int(end[i]), block):
                    part = table[buf[a : min(a + block, int(end[i]))]]
                    out[i] += (part * powers[: len(part)]).sum(dtype=np.uint64) * power
                    power = power * powers[block]
            i += 1
            continue
        first, size = upto[i:j] - upto[i], np.diff(upto[i : j + 1])
        inside = np.arange(upto[j] - upto[i]) - np.repeat(first, size)
        out[i:j] = np.add.reduceat(table[buf[np.repeat(at[i:j], size) + inside]] * powers[inside], first)
        i = j
    return mix(out)


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each run of `size`, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def shingles(h: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted, as hashes, and the offsets of the texts.

    A text with fewer than k words has its whole sequence as its one shingle; without words, none.
    """
    n = np.diff(offs)
    out_h, out_d = [], []
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            acc = acc * _MULT + h[j : len(h) - k + 1 + j]
        doc = np.repeat(np.arange(len(n)), n)
        ok = doc[: len(acc)] == doc[k - 1 :]
        out_h.append(mix(acc[ok]))
        out_d.append(doc[: len(acc)][ok])
    for d in np.flatnonzero((n > 0) & (n < k)):
        acc = np.uint64(n[d])
        for x in h[offs[d] : offs[d + 1]]:
            acc = np.uint64((int(acc) * int(_MULT) + int(x)) & 0xFFFFFFFFFFFFFFFF)
        out_h.append(mix(np.array([acc], np.uint64)))
        out_d.append(np.array([d]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    hh, dd = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((hh, dd))
    hh, dd = hh[order], dd[order]
    keep = np.ones(len(hh), bool)
    keep[1:] = (hh[1:] != hh[:-1]) | (dd[1:] != dd[:-1])
    hh, dd = hh[keep], dd[keep]
    return hh, np.searchsorted(dd, np.arange(len(n) + 1))


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of the first 0 to n hashes, modulo 2**64."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])


def signed(x: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---------------------------------------------------------------- hot keys


def join_back(rows: DataFrame, table: DataFrame, on: str | list[str], weight: str, how: str = "inner") -> DataFrame:
    """Rows joined with a table of one row a key, whose column `weight` is the number of rows of that key.

    Keys of more than a thousandth of all rows are at most a thousand, so they are broadcast; the
    rows of the others are shuffled. The table is read several times, so give a cut one."""
    many = (table.agg(F.sum(weight)).first()[0] or 0) / 1000
    hot = F.broadcast(table.where(F.col(weight) > many).drop(weight))
    rest = rows.join(hot, on, "left_anti").join(table.where(F.col(weight) <= many).drop(weight), on, how)
    return rows.join(hot, on).unionByName(rest)


def stars(rows: DataFrame, key: str, node: str, salts: int = 64) -> DataFrame:
    """Links a, b that chain all nodes (long) of each key, with the keys' rows dealt over salted groups:
    to the least node of the group, and from there to the least one of the key. Rows are read twice."""
    salt = F.pmod(F.xxhash64(node), F.lit(salts)).alias("salt")
    rows = rows.select(key, F.col(node).alias("a"), salt)
    inner = rows.withColumn("b", F.min("a").over(Window.partitionBy(key, "salt"))).select("a", "b")
    outer = rows.groupBy(key, "salt").agg(F.min("a").alias("a")).withColumn("b", F.min("a").over(Window.partitionBy(key))).select("a", "b")
    return inner.unionByName(outer).where("a <> b")
