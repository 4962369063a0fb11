"""N-gram Jaccard join by T-occurrence search with DivideSkip, split over exact shards.

Two documents link when their sets of word shingles have a Jaccard similarity of at least
num / den. Every step is exact (up to collisions of 64-bit hashes):

1. Documents with equal sets collapse to one representative, so copies cost nothing further.
2. Shards. The range of hashes is cut into 2^c equal parts, and the shingles of a set in one part
   are a piece of it. Two sets that link differ in at most d = n (den - num) / num shingles, n the
   size of either, so in at most d pieces, and share one of the d + 1 pieces that come first in each
   by any one order; by rising number of sets that hold them, these are the rare ones, and pieces of
   one set alone, which come before all others, need not be looked at again. c grows with n, so that
   pieces are larger where fewer shingles may differ, and there are some 2 d of them or more; sets
   whose lesser partners have another c are cut by that as well, as another set. Linked sets that
   share no piece have d or fewer both, and sets of so few (hardly any) have one more piece, the same
   for all. The numbers are exact: tasks send their pieces' hashes, once for each set, packed by ranges of these; a range's
   task counts them and sends on those of two or more sets, packed by ranges of the sets' hashes.
   Pieces that fill up a range (a phrase in a third of the documents) come last in the order, by
   hash, and are not sent; they are told by their counts in slices of the first pass. Sets that
   share a first piece are chained, and the components of these chains are the shards: no link
   crosses them.
3. In a shard, an inverted index from shingle to documents answers each document's T-occurrence
   query: with T the least overlap, its L longest lists are put aside, the short ones are merged
   and counted, those reaching T - L are probed in the long lists. (Where most documents of a list
   are candidates, the long lists are counted too, which is cheaper than a probe for each.)
   Small shards share tasks up to a size; a larger one is cut into blocks and each pair of blocks
   is a task, so no task grows with a group of copies. Pairs are counted there, never emitted;
   each task returns a spanning forest of its links.
4. Components of the forests.

Null doc_id: no row from `jaccard_components`; `query` adds these with a null component. Null or
wordless text: an empty set, linked with nothing. Rows that repeat a doc_id each give a row. Very
long texts are hashed in pieces, and are one set. Columns other than doc_id and text are not read.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from groundtrack.llm.common import SLICE_BYTES, components, cut, drop_cut, fresh, gathered, join_back, mix, prefix_sums, shingles, signed, slices, stars, utf8, words

#: Shingles in one block of an inverted index.
BLOCK = 1 << 20
#: Pieces in a range of their hashes, and of the sets in a range of these.
RANGE = 1 << 20
#: Sets are cut by 2^5 parts of the hashes at least, else many a small set would fill no more than differ.
LEAST_LEVEL = 5
#: At most so many pieces are taken as common ones: 1 MB of hashes in each task.
COMMON = 1 << 17
#: Common ones are in so many distinct sets of a slice, in more slices than this: they would fill an eighth of a range.
OFTEN = 8
OFTEN_SLICES = RANGE // 8 // OFTEN


def _set_hashes(s: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set, from sums over its shingles; the first one's last bit is 0, for `_pieces`."""
    c1, c2 = prefix_sums(s), prefix_sums(mix(s + np.uint64(77)))
    return mix(c1[offs[1:]] - c1[offs[:-1]]) & ~np.uint64(1), mix(c2[offs[1:]] - c2[offs[:-1]])


def _short(s: np.ndarray) -> np.ndarray:
    """48 bits of a piece's hash: by these pieces are counted, ordered and met."""
    return s >> np.uint64(16)


def _level(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """c: sets of n shingles are cut by 2^c parts of the hashes, the least that are 2 n (den - num) / num
    or more. Sets that link have the same c or neighbouring ones."""
    step = max(1, (-(-den // num) - 1).bit_length())
    _, c = np.frexp(np.maximum(-(-2 * n * (den - num) // num), 1) - 1)
    return -(-np.maximum(c, LEAST_LEVEL).astype(np.int64) // step) * step


def _pieces(s: np.ndarray, offs: np.ndarray, num: int, den: int) -> tuple[np.ndarray, ...]:
    """Hashes of the pieces of each set that others can be linked with, the offsets of the sets in these,
    each one's row, how many of its pieces come first (d + 1), and 1 where it is cut by its least partners' c."""
    n = np.diff(offs)
    own, least = _level(n, num, den), _level(-(-n * num // den), num, den)
    most = n * (den - num) // num
    row = np.concatenate([np.flatnonzero(most > 0), np.flatnonzero((most > 0) & (least < own))])
    again = np.arange(len(row)) >= int((most > 0).sum())
    level = np.where(again, least[row], own[row]).astype(np.uint64)
    x, of = s[gathered(offs[row], n[row])], np.repeat(np.arange(len(row)), n[row])
    part = x >> (np.uint64(63) - level[of]) >> np.uint64(1)
    new = np.ones(len(x), bool)
    new[1:] = (of[1:] != of[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(new)
    p = mix((np.add.reduceat(mix(x + np.uint64(78)), at) if len(at) else x) + level[of[at]])
    ends = np.searchsorted(of[at], np.arange(len(row) + 1))
    few = np.diff(ends) <= most[row]
    p = np.insert(p, ends[1:][few], mix(mix(level[few] + np.uint64(79))))
    return p, ends + np.concatenate([[0], np.cumsum(few)]), row, most[row] + 1, again.astype(np.uint64)


_PROFILE = "doc_id long, n long, h1 long, h2 long, pieces long, often array<long>"


def _profile(k: int, num: int, den: int):
    """Size, hashes and number of pieces of each row's set; the first row of a slice also tells the
    pieces that OFTEN of its distinct sets hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(1))
            for a, b in slices(offs, SLICE_BYTES // 2):
                h, _, woffs = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, soffs = shingles(h, woffs, k)
                h1, h2 = _set_hashes(s, soffs)
                first = np.zeros(b - a, bool)
                first[np.unique(h1, return_index=True)[1]] = True
                p, poffs, row, _, _ = _pieces(s, soffs, num, den)
                ids, times = np.unique(_short(p[np.repeat(first[row], np.diff(poffs))]), return_counts=True)
                pieces = np.bincount(row, np.diff(poffs), b - a).astype(np.int64)
                often = ids[times >= OFTEN]
                tell = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.full(b - a, len(often))]).astype(np.int32)), signed(often))
                yield pa.record_batch({"doc_id": batch.column(0).slice(a, b - a), "n": pa.array(np.diff(soffs)), "h1": signed(h1), "h2": signed(h2), "pieces": pa.array(pieces), "often": tell})

    return run


def _pack(x: np.ndarray) -> bytes:
    """Numbers below the length of a dictionary, in as few bytes as hold them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0)).tobytes()


def _unpack(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}").astype(np.int64)


_PACKED = "part long, low binary, high binary, who binary, h1 binary, room binary"


def _packed(part: np.ndarray, ids: np.ndarray, owner: np.ndarray, h1: np.ndarray, room: np.ndarray) -> Iterator[dict]:
    """A row for each part: pieces and, by a dictionary, the sets' hashes and room. Parts are sorted."""
    ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part))
    a = 0
    for b in ends if len(part) else ():
        known, who = np.unique(owner[a:b], return_inverse=True)
        yield {
            "part": int(part[a]),
            "low": (ids[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
            "high": (ids[a:b] >> np.uint64(32)).astype(np.uint16).tobytes(),
            "who": _pack(who),
            "h1": h1[known].tobytes(),
            "room": room[known].astype(np.int32).tobytes(),
        }
        a = b


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """Piece, set hash and room of all entries of packed rows."""
    ids, h1, room = [], [], []
    for low, high, who, own, left in zip(rows.low, rows.high, rows.who, rows.h1, rows.room, strict=True):
        low = np.frombuffer(low, np.uint32)
        who = _unpack(who, len(low))
        ids.append(low.astype(np.uint64) | (np.frombuffer(high, np.uint16).astype(np.uint64) << np.uint64(32)))
        h1.append(np.frombuffer(own, np.uint64)[who])
        room.append(np.frombuffer(left, np.int32)[who])
    return np.concatenate(ids), np.concatenate(h1), np.concatenate(room)


def _range_of(x: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Which of equal ranges of numbers of so many bits each lies in."""
    return (((x >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _deal(k: int, num: int, den: int, common: np.ndarray, parts: int):
    """Packed rows of all pieces but common ones, by range. room is how many of the pieces that
    other sets hold as well come first at most, once all of them but the common ones are ahead:
    the length of the beginning less the pieces that are not common. Where room is left for
    common ones, these follow as rows of parts from the number of ranges on."""

    def flush(sets: tuple[np.ndarray, ...], first: tuple[int, ...], h1: list[int]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        ids, owner, hashes = _short(np.concatenate(sets)), np.repeat(np.arange(len(n)), n), np.array(h1, np.uint64)
        at = np.minimum(np.searchsorted(common, ids), max(0, len(common) - 1))
        is_common = common[at] == ids if len(common) else np.zeros(len(ids), bool)
        room = np.array(first, np.int64) - (n - np.bincount(owner[is_common], minlength=len(n)))
        rest, who = ids[~is_common], owner[~is_common]
        order = np.argsort(rest, kind="stable")
        rest, who = rest[order], who[order]
        rows = list(_packed(_range_of(rest, 48, parts), rest, who, hashes, room))
        last, who = ids[is_common], owner[is_common]
        order = np.lexsort((last, who))
        last, who = last[order], who[order]
        nth = np.arange(len(who)) - np.searchsorted(who, who)
        begin = nth < room[who]
        rows += _packed(np.full(int(begin.sum()), parts + int(hashes[0] % np.uint64(parts))), last[begin], who[begin], hashes, room)
        return pa.RecordBatch.from_pylist(rows, pa.schema([("part", pa.int64())] + [(c, pa.binary()) for c in ("low", "high", "who", "h1", "room")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, tuple[np.ndarray, int]] = {}  # of equal sets, one speaks for all
        size = 0
        for batch in batches:
            buf, offs = utf8(batch.column(0))
            for a, b in slices(offs, SLICE_BYTES // 2):
                h, _, woffs = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, soffs = shingles(h, woffs, k)
                p, poffs, row, first, again = _pieces(s, soffs, num, den)
                h1 = _set_hashes(s, soffs)[0][row] | again
                for i, own in enumerate(h1.tolist()):
                    if own not in sets:
                        sets[own] = p[poffs[i] : poffs[i + 1]], int(first[i])
                        size += int(poffs[i + 1] - poffs[i])
                if size >= RANGE // 2:
                    yield flush(*zip(*sets.values(), strict=True), list(sets))
                    sets, size = {}, 0
        if sets:
            yield flush(*zip(*sets.values(), strict=True), list(sets))

    return run


def _count(parts: int):
    """Entries of a range of pieces that two or more sets hold, packed by range of the sets. Common
    pieces go on as they are, under negative parts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if rows.part.iloc[0] >= parts:
            return rows.assign(part=parts - 1 - rows.part, times=b"")
        ids, h1, room = _unpacked(rows)
        ids, owners, times = np.unique(ids, return_inverse=True, return_counts=True)
        some = times[owners] > 1  # the same set twice is not told apart yet
        ids, h1, room = ids[owners[some]], h1[some], room[some]
        del owners, times, some
        order = np.lexsort((h1, ids))
        ids, h1, room = ids[order], h1[order], room[order]
        new = np.ones(len(ids), bool)
        new[1:] = ids[1:] != ids[:-1]
        each = new.copy()
        each[1:] |= h1[1:] != h1[:-1]
        ids, h1, room, new = ids[each], h1[each], room[each], new[each]
        at = np.flatnonzero(new)
        times = np.repeat(np.diff(np.append(at, len(ids))), np.diff(np.append(at, len(ids))))
        met = times > 1
        ids, h1, room, times = ids[met], h1[met], room[met], times[met]
        part = _range_of(h1, 64, parts)
        order = np.argsort(part, kind="stable")
        ids, h1, room, times, part = ids[order], h1[order], room[order], times[order], part[order]
        known, first, owner = np.unique(h1, return_index=True, return_inverse=True)
        out = pd.DataFrame(list(_packed(part, ids, owner, known, room[first])), columns=["part", "low", "high", "who", "h1", "room"])
        ends = np.append(np.flatnonzero(np.diff(part)) + 1, len(part)) if len(part) else []
        out["times"] = [times[a:b].astype(np.uint32).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)] if len(part) else []
        return out

    return run


def _first_ones(rows: pd.DataFrame) -> pd.DataFrame:
    """g and h1: pieces at the beginning of each set of a range that other sets hold as well."""
    ids, h1, room = _unpacked(rows)
    node = (h1 & ~np.uint64(1)).view(np.int64)
    if rows.part.iloc[0] < 0:
        return pd.DataFrame({"g": ids.view(np.int64), "h1": node}).drop_duplicates()
    times = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.times])
    order = np.lexsort((ids, times, h1))
    ids, h1, room, node = ids[order], h1[order], room[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], h1[1:] != h1[:-1]]))
    met = np.diff(np.append(start, len(h1)))
    nth = np.arange(len(h1)) - np.repeat(start, met) + 1
    first = nth - np.repeat(met, met) <= room
    return pd.DataFrame({"g": ids[first].view(np.int64), "h1": node[first]})


def _shards(texts: DataFrame, often: DataFrame, total: int, k: int, num: int, den: int) -> DataFrame:
    """node (the hash of a set) and component, for sets that share a piece of their beginnings."""
    ranges = max(1, -(-total // RANGE))
    common = often.groupBy("id").agg(F.count("*").alias("slices")).where(f"slices > {OFTEN_SLICES}")
    common = common.orderBy(F.desc("slices"), "id").limit(COMMON).collect()
    common = np.sort(np.array([r.id for r in common], np.int64).view(np.uint64))
    # entries name their sets, so a part that is made again by another task is the same
    dealt = texts.mapInArrow(_deal(k, num, den, common, ranges), _PACKED)
    counted = dealt.groupBy("part").applyInPandas(_count(ranges), _PACKED + ", times binary")
    first = cut(counted.groupBy("part").applyInPandas(_first_ones, "g long, h1 long"))
    found = components(stars(first, "g", "h1"))
    drop_cut(first)
    return found


def _sets(k: int):
    """Sets of the texts whose set has the hash asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = utf8(batch.column(0))
            asked = batch.column(1).to_numpy()
            for a, b in slices(offs, SLICE_BYTES // 2):
                h, _, woffs = words(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                s, soffs = shingles(h, woffs, k)
                ok = np.flatnonzero(_set_hashes(s, soffs)[0].view(np.int64) == asked[a:b])
                yield pa.record_batch({"h1": pa.array(asked[a:b][ok]), "shingles": pa.array([s[soffs[i] : soffs[i + 1]].tobytes() for i in ok], pa.binary())})

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int, side: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """For each set i, the sets j < i of Jaccard similarity num / den or more (with `side` given,
    only those of another side). Sets are arrays of distinct hashes."""
    n = np.array([len(s) for s in sets], np.int64)
    count, docs = len(sets), np.repeat(np.arange(len(sets)), n)
    if not len(docs):
        return
    _, rank = np.unique(np.concatenate(sets), return_inverse=True)
    key = rank.astype(np.int64) * count + docs
    order = np.argsort(key, kind="stable")
    posts, owner = key[order], docs[order]
    low = np.searchsorted(posts, np.arange(rank.max() + 2) * count)
    where = np.empty(len(key), np.int64)
    where[order] = np.arange(len(key))
    length = np.diff(low)
    offs = np.concatenate([[0], np.cumsum(n)])

    def gather(lists: np.ndarray, upto: np.ndarray) -> np.ndarray:
        size = upto - low[lists]
        total = int(size.sum())
        start = np.repeat(low[lists] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        return owner[np.arange(total) + start]

    for i in range(1, count):
        a = int(n[i])
        if not a:
            continue
        own, at = rank[offs[i] : offs[i + 1]], where[offs[i] : offs[i + 1]]
        by = np.argsort(length[own], kind="stable")
        own, at = own[by], at[by]
        t = -(-num * a // den)
        skip = max(0, min(t - 1, int(t / (0.0085 * math.log2(max(2, length[own[-1]])) + 1))))
        short, rest = own[: a - skip], own[a - skip :]
        met = gather(short, at[: a - skip])
        if not len(met):
            continue
        if len(met) * 8 < i:
            found, times = np.unique(met, return_counts=True)
        else:
            times = np.bincount(met, minlength=i)
            found = np.flatnonzero(times)
            times = times[found]
        ok = (times >= t - skip) & (n[found] * den >= num * a) & (a * den >= num * n[found])
        if side is not None:
            ok &= side[found] != side[i]
        found, times = found[ok], times[ok]
        if not len(found):
            continue
        if len(rest):
            upto = at[a - skip :]
            if len(found) * len(rest) * 8 < int((upto - low[rest]).sum()) or len(found) <= 4:
                probe = (rest[:, None] * count + found[None, :]).ravel()
                hit = np.minimum(np.searchsorted(posts, probe), len(posts) - 1)
                times = times + (posts[hit] == probe).reshape(len(rest), -1).sum(axis=0)
            else:
                times = times + np.bincount(gather(rest, upto), minlength=i)[found]
        ok = den * times >= num * (a + n[found] - times)
        if ok.any():
            yield i, found[ok]


def _search(num: int, den: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["node", "mine"]).sort_values("node")
        sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        node, times = pdf.node.to_numpy(), pdf.times.to_numpy()
        across = pdf.i.iloc[0] != pdf.j.iloc[0]
        links = np.zeros(len(node), np.int64)
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []
        for i, found in divide_skip(sets, num, den, pdf.mine.to_numpy() if across else None):
            links[i] += times[found].sum()
            np.add.at(links, found, times[i])
            for j in found:
                x, y = find(i), find(int(j))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    forest.append((node[i], node[j], 0))
        rows = forest + [(x, x, k) for x, k in zip(node, links, strict=True) if k]
        return pd.DataFrame(rows, columns=["a", "b", "links"]).astype("int64")

    return run


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reached by links) and n_links of each row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    told = cut(docs.mapInArrow(_profile(k, num, den), _PROFILE))
    seen = told.drop("pieces", "often")
    told_sets = told.where("n > 0").groupBy("h1", "h2")
    reps = cut(told_sets.agg(F.min("doc_id").alias("rep"), F.count("*").alias("times"), F.first("n").alias("n"), F.first("pieces").alias("pieces")))
    total = reps.agg(F.sum("pieces")).first()[0] or 0
    # sets go by their hash, so that copies which tasks have not seen together meet as one
    shard = _shards(docs.select("text"), told.select(F.explode("often").alias("id")), total, k, num, den)

    held = cut(shard.join(reps, F.col("node") == F.col("h1")).select("h1", "rep", "component", "times", "n"))
    size = cut(held.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("sets")))
    sets = docs.join(held.select("h1", "rep"), F.col("doc_id") == F.col("rep")).select("text", "h1")
    sets = cut(sets.mapInArrow(_sets(k), "h1 long, shingles binary").dropDuplicates(["h1"]))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    tasks = max(1, -(-(size.agg(F.sum("size")).first()[0] or 0) // BLOCK))
    held = join_back(held, size, "component", "sets").select(
        "h1",
        "times",
        blocks.alias("blocks"),
        F.when(blocks == 1, F.pmod(F.xxhash64("component"), F.lit(tasks))).otherwise(F.col("component")).alias("shard"),
        F.pmod(F.xxhash64("h1", F.lit(1)), blocks).alias("mine"),
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tasks = held.join(sets, "h1").select(F.col("h1").alias("node"), "times", "blocks", "shard", "mine", "shingles", other.alias("other"))
    tasks = tasks.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "parted": F.col("blocks") > 1}).drop("other", "blocks")
    links = cut(tasks.groupBy("parted", "shard", "i", "j").applyInPandas(_search(num, den), "a long, b long, links long"))
    drop_cut(sets)

    joined = components(links.select("a", "b"))
    counted = links.groupBy(F.col("a").alias("h1")).agg(F.sum("links").alias("links"))
    reps = cut(reps.join(joined.select(F.col("node").alias("h1"), "component"), "h1", "left").join(counted, "h1", "left"))
    lowest = cut(reps.where("component is not null").groupBy("component").agg(F.min("rep").alias("low"), F.count("*").alias("sets")))
    reps = join_back(reps, lowest, "component", "sets", "left")
    reps = cut(reps.select("h1", "h2", "times", F.coalesce("low", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("links")))
    keys = ["h1", "h2"]
    some = seen.select("doc_id", "n", *(F.when(F.col("n") > 0, F.col(c)).alias(c) for c in keys))
    return join_back(some, reps, keys, "times", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
    )


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents, all their columns, with only the smallest doc_id of each component; one row of
    each doc_id. Rows without doc_id stay."""
    nth, key = fresh(docs, "_nth"), fresh(docs, "_doc_id")
    kept = jaccard_components(docs, k, num, den).where("doc_id = component_id").select(F.col("doc_id").alias(key))
    rows = docs.join(kept, docs["doc_id"] == F.col(key), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    return rows.withColumn(nth, first).where(F.col(nth) == 1).drop(nth).unionByName(docs.where("doc_id is null"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: components over links of 3-word shingles at a similarity of 0.9; a row without doc_id is in
    no component, and its set is counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    nameless = docs.where("doc_id is null").mapInArrow(_profile(3, 90, 100), _PROFILE)
    none = F.lit(None).cast("long")
    nameless = nameless.select("doc_id", F.col("n").alias("n_shingles"), none.alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return jaccard_components(docs, 3, 90, 100).unionByName(nameless)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM e x JOIN e y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a)
SELECT n.doc_id AS doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id,
  (SELECT count(*) FROM d WHERE d.a = n.doc_id) AS n_links
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
