"""Compression of vectors to part codes: Lloyd's rounds with Hamerly's bounds, in whole numbers.

A component x becomes floor(256 * x); a vector is cut into 16 equal consecutive parts, and each part
position has a codebook of up to 64 entries. A codebook starts as that part of the 64 smallest kept
vec_ids. Each of 2 rounds assigns each part to its codebook's nearest entry (squared distance, ties
to the lower index) and replaces an entry by the componentwise floor(sum / count) of its parts; an
unused entry stays. At the end the parts are assigned again.

1. Kept rows are written once as whole numbers. The first assignment scans all entries and writes,
   beside the code, one upper bound (distance to its entry) and one lower bound (distance to the
   second nearest) for each part.
2. After an update, an upper bound grows by what its entry moved and a lower bound shrinks by the
   most that another entry moved. A part keeps its entry if the upper bound is strictly below the
   lower bound, or below half the distance from its entry to the next one; else the upper bound is
   made exact and tried again; else all entries are scanned in whole numbers. Since an equality
   scans, ties always go to the lower index. Bounds err on the safe side of rounding.
3. Sums and counts of entries are added up in the tasks, at most 16 * 64 rows a batch, and meet by
   part and entry. Only the codebooks (16 * 64 entries of a sixteenth of a vector) come to the driver.

Rows with null vectors, or null or non-finite components, are dropped. Rows that repeat a vec_id or
lack one are kept rows each; as codebook starts they come in order of vec_id (null last), then of
their components. All codebooks are of vectors as long as the first of these with a length that 16
divides; vectors of other lengths have no code: null code and error, and they count 0 in
label_error. With fewer than 64 vectors, codebooks have fewer entries. Components beyond a limit that
keeps squared distances within 62 bits (2**27 for 64 components) are held there; label_error is held
within a long. An empty table gives an empty result. Columns other than vec_id, embedding and label
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack.llm.common import cut, drop_cut, join_back

#: Rows of a batch that are worked on at once.
ROWS = 2048
#: Components that are summed at once.
SUMMED = 1 << 20
#: Share by which a bound is widened, so that the rounding of doubles never makes it wrong.
SLACK = 2.0**-44

_STATE = "vec_id long, label string, v binary, code binary, upper binary, lower binary, error long"


def limit(dims: int) -> int:
    """The greatest size of a component: squared distances of whole vectors stay within 62 bits."""
    return int(((1 << 60) // max(1, dims)) ** 0.5)


def whole(vectors: DataFrame, parts: int = 16, scale: int = 256) -> DataFrame:
    """vec_id, label (as text) and v (32-bit whole numbers) of kept rows; v is null if parts do not divide it."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            offsets = x.offsets.to_numpy()
            flat = x.values.to_numpy(zero_copy_only=False)
            v = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                if a == b or (b - a) % parts:
                    v.append(None)
                    continue
                most = float(limit(int(b - a)))
                with np.errstate(over="ignore"):
                    v.append(np.clip(np.floor(flat[a:b] * scale), -most, most).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(v, pa.binary())], ["vec_id", "label", "v"])

    return rows.mapInArrow(run, "vec_id long, label string, v binary")


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Codebooks by part and entry, from the smallest vec_ids; None without a vector that parts divide."""
    ids = F.col("vec_id").asc_nulls_last()
    order = F.transform(F.sequence(F.lit(1), F.octet_length("v"), F.lit(4)), lambda i: F.conv(F.hex(F.reverse(F.substring("v", i, F.lit(4)))), 16, 10).cast("long"))
    signed = F.transform(order, lambda c: F.when(c >= 1 << 31, c - (1 << 32)).otherwise(c))
    known = rows.where("v is not null and octet_length(v) > 0")
    one = known.orderBy(ids, signed).select("v").limit(1).collect()
    if not one:
        return None
    same = known.where(F.octet_length("v") == len(one[0].v))
    least = same.orderBy(ids, signed).select("v").limit(entries).collect()
    v = np.stack([np.frombuffer(r.v, "<i4") for r in least]).astype(np.int64)
    return np.ascontiguousarray(v.reshape(len(v), parts, -1).transpose(1, 0, 2))


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to entries c, exact: by products of doubles where these are, else in whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 52:
        xf, cf = x.astype(float), c.astype(float)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in c], axis=1)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full scan: nearest entry (the lower of equals), upper and lower bound of each row."""
    d = distances(x, c)
    code = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(x)), code].astype(float)) * (1 + SLACK)
    lower = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(float)) * (1 - SLACK) if len(c) > 1 else np.full(len(x), np.inf)
    return code, upper, lower


def moves(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a codebook's entries: how far each moved, the most that another one moved, half the way to the next entry."""
    k = len(new)
    moved = np.sqrt(((new - old) ** 2).sum(1).astype(float)) * (1 + SLACK)
    rest = np.array([np.delete(moved, i).max(initial=0) for i in range(k)])
    gaps = distances(new, new)
    half = np.array([np.sqrt(float(np.delete(gaps[i], i).min())) / 2 if k > 1 else np.inf for i in range(k)]) * (1 - SLACK)
    return moved, rest, half


def kept_or_scanned(x, code, upper, lower, c, change) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hamerly's step for a part position: code, bounds, and which rows took a full scan."""
    moved, rest, half = change
    upper, lower = (upper + moved[code]) * (1 + SLACK), np.maximum(lower - rest[code], 0) * (1 - SLACK)
    open_ = np.flatnonzero(~(upper < np.maximum(lower, half[code])))
    upper[open_] = np.sqrt(((x[open_] - c[code[open_]]) ** 2).sum(1).astype(float)) * (1 + SLACK)
    open_ = open_[~(upper[open_] < np.maximum(lower[open_], half[code[open_]]))]
    code = code.copy()
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], c)
    return code, upper, lower, open_


def assigned(rows: DataFrame, books: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """The rows with code, bounds and error under these codebooks; with those before, by the persisted bounds."""
    parts, _, width = books.shape
    size = 4 * parts * width
    change = [moves(old, new) for old, new in zip(before, books, strict=True)] if before is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                told = np.array([v is not None and len(v) == size for v in piece.column("v").to_pylist()], bool)
                mine = piece.filter(pa.array(told))
                n = mine.num_rows
                numbers = lambda name, kind, data=mine: np.frombuffer(b"".join(data.column(name).to_pylist()), kind)
                v = numbers("v", "<i4").reshape(n, parts, width).astype(np.int64)
                code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts)), np.zeros((n, parts))
                if change:
                    code[:], upper[:], lower[:] = (numbers(c, kind).reshape(n, parts) for c, kind in (("code", np.uint8), ("upper", "<f8"), ("lower", "<f8")))
                error = np.zeros(n, np.int64)
                for p in range(parts if n else 0):
                    x = v[:, p]
                    if change:
                        code[:, p], upper[:, p], lower[:, p], _ = kept_or_scanned(x, code[:, p], upper[:, p], lower[:, p], books[p], change[p])
                    else:
                        code[:, p], upper[:, p], lower[:, p] = scan(x, books[p])
                    error += ((x - books[p][code[:, p]]) ** 2).sum(1)
                out = {"vec_id": piece.column("vec_id"), "label": piece.column("label"), "v": piece.column("v")}
                each = np.full(len(told), -1)
                each[told] = np.arange(n)
                for name, a in (("code", code.astype(np.uint8)), ("upper", upper.astype("<f8")), ("lower", lower.astype("<f8"))):
                    out[name] = pa.array([a[i].tobytes() if i >= 0 else None for i in each], pa.binary())
                out["error"] = pa.array([int(error[i]) if i >= 0 else None for i in each], pa.int64())
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(run, _STATE)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks after each entry is replaced by the floor of its parts' mean."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SUMMED // (parts * width))
        for batch in batches:
            for piece in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                n = piece.num_rows
                v = np.frombuffer(b"".join(piece.column("v").to_pylist()), "<i4").astype(np.int64)
                code = np.frombuffer(b"".join(piece.column("code").to_pylist()), np.uint8).reshape(n, parts).astype(np.int64)
                slot = (code + np.arange(parts) * k).ravel()
                order = np.argsort(slot, kind="stable")
                slots, first = np.unique(slot[order], return_index=True)
                sums = np.add.reduceat(v.reshape(n * parts, width)[order], first, axis=0)
                count = np.diff(np.append(first, n * parts))
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(count), pa.array(list(sums), pa.list_(pa.int64()))], ["slot", "n", "sums"])

    part = rows.where("code is not null").select("v", "code").mapInArrow(run, "slot long, n long, sums array<long>")
    exact = "decimal(38,0)"
    sums = [F.sum(F.col("sums")[i].cast(exact)).alias(f"s{i}") for i in range(width)]
    new = books.copy()
    for r in part.groupBy("slot").agg(F.sum("n").alias("n"), *sums).collect():  # a row an entry at most
        new[r.slot // k, r.slot % k] = [int(r[f"s{i}"]) // int(r.n) for i in range(width)]
    return new


def compressed(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> tuple[DataFrame, np.ndarray | None]:
    """vec_id, label (as text), code and error of the kept rows, and the final codebooks by part and entry."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is one byte")
    rows = cut(whole(vectors, parts))
    books = first_entries(rows, parts, entries)
    if books is None:
        return rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), None
    state = cut(assigned(rows, books))
    drop_cut(rows)
    for _ in range(rounds):
        new = updated(state, books)
        after = cut(assigned(state, new, books))
        drop_cut(state)
        state, books = after, new
    return state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), books


def fingerprint(books: np.ndarray | None) -> str:
    """sha256 of all entries' components in decimal, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode() if books is not None else b"").hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    """op12: code and error of each kept vector, the error of its label and the codebooks' hash."""
    rows, books = compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    total = F.least(F.coalesce(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(0)), most).cast("long")
    by_label = cut(rows.groupBy("key").agg(total.alias("label_error"), F.count("*").alias("weight")))
    out = join_back(rows, by_label, "key", "weight")
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))


def _round(name: str, books: str) -> str:
    """SQL of an assignment under a codebook table."""
    return f"""
{name} AS (
  SELECT vec_id, label, p, x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT t.vec_id, t.label, t.p, t.x, b.e, list_sum(list_transform(list_zip(t.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM t JOIN {books} b USING (p)) GROUP BY ALL)"""


def _update(name: str, codes: str, books: str) -> str:
    """SQL of a codebook table after an assignment."""
    floor = "(list_sum(c) - ((list_sum(c) % len(c)) + len(c)) % len(c)) // len(c)"
    return f"""
{name} AS (
  SELECT b.p, b.e, coalesce(u.x, b.x) AS x FROM {books} b LEFT JOIN (
    SELECT p, e, list(y ORDER BY i) AS x FROM (
      SELECT p, e, i, {floor} AS y FROM (SELECT p, e, i, list(x[i]) AS c FROM {codes}, range(1, len(x) + 1) r(i) GROUP BY p, e, i)) GROUP BY p, e) u USING (p, e))"""


SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (
  SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM t) WHERE e < 64),
{_round("c0", "b0").replace(" AS (", " AS MATERIALIZED (", 1).strip()},
{_update("b1", "c0", "b0").replace(" AS (", " AS MATERIALIZED (", 1).strip()},
{_round("c1", "b1").replace(" AS (", " AS MATERIALIZED (", 1).strip()},
{_update("b2", "c1", "b1").replace(" AS (", " AS MATERIALIZED (", 1).strip()},
{_round("c2", "b2").replace(" AS (", " AS MATERIALIZED (", 1).strip()},
r AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM c2 GROUP BY vec_id, label),
s AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM s) AS codebooks_sha256 FROM r
"""
