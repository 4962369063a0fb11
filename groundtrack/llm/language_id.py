"""Language ID by hierarchical discrimination.

The language family is predicted first; within it, one-versus-one linear support vector machines
separate its languages, and the language with most votes (then the largest sum of margins) wins.
Families of languages outside FAMILIES hold that language alone.

Features: hashed n-grams (1 to 4) of the lowered text in which each run of characters other than
letters is one space; square roots of counts, scaled to length 1; over whole texts, of which long
ones are counted piece by piece without a seam. The machines
(squared hinge loss, by accelerated gradient steps) are fitted, on the driver or in one task, on about SAMPLE labelled documents
(never more than twice as many), shared equally by the LANGUAGES most frequent labels and chosen by a hash of
doc_id and text, so that rows of one id are drawn one by one; equal ones count once. Features are made in
the tasks. Labels are read from rows whose crc32(doc_id) mod 5 is not 0 only.

Text that is null or has no letter: `und`, score 0. Score: a logistic function of the least margin
on the way, above 0.5 where all machines agree. Without labelled rows, all is `und`; an empty table gives
no rows. Equal votes go to the larger sum of margins, then to the first language by name. Rows that
repeat a doc_id each give a row; further columns are kept by `keep` and not read elsewhere.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack.llm.common import few, held_out, slices, unseen, utf8

#: Labelled documents to learn from, over all languages.
SAMPLE = 2400
#: Labels that are learned, the most frequent ones.
LANGUAGES = 400
BINS = 1 << 13
PIECE = 1 << 20

FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi ur bn pa mr gu ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv su",
    "celtic": "ga cy gd br",
    "baltic": "lt lv",
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter; made once in a worker."""
    if not _LETTER:
        _LETTER.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTER[0]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of scaled n-gram counts for each text, and whether it has a letter. Pieces of PIECE characters
    bound the arrays of a very long text; each goes on from the last three places of the one before."""
    letters, rows, has = _letters(), np.zeros((len(texts), BINS), np.float32), np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        counts, text = np.zeros(BINS, np.int64), text.lower()
        seam, spaced = np.array([32], np.uint32), False
        for at in range(0, max(1, len(text)), PIECE):
            x = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
            ok = letters[x]
            has[i] |= ok.any()
            one = np.ones(len(x), bool)
            one[1:] = ok[1:] | ok[:-1]
            if at and len(x):
                one[0] = ok[0] or not spaced
            spaced = len(x) > 0 and not ok[-1]
            x = np.where(ok, x, 32).astype(np.uint32)[one]
            last = [32] if at + PIECE >= len(text) else []
            x, known = np.concatenate([seam, x, last]).astype(np.uint32), len(seam) if at else 0
            acc = x * np.uint32(2654435761)
            for n in range(1, 5):
                if n > 1:
                    acc = (acc[:-1] ^ np.uint32(0x5BD1E995 * n & 0xFFFFFFFF)) * np.uint32(0x01000193) + x[n - 1 :] * np.uint32(2654435761)
                    acc ^= acc >> np.uint32(15)
                fresh = acc[max(0, known - n + 1) :]  # those that end in this piece
                counts += np.bincount((fresh >> np.uint32(7)) & np.uint32(BINS - 1), minlength=BINS)
            seam = x[-3:]
        if has[i]:
            root = np.sqrt(counts)
            rows[i] = root / np.sqrt((root * root).sum())
    return rows, has


def fit_svm(x: np.ndarray, y: np.ndarray, strength: float = 30.0, steps: int = 150) -> np.ndarray:
    """Weights and bias (last) of a linear machine for labels of -1 and 1, classes weighing equally."""
    forth = lambda v: x @ v[:-1] + v[-1]
    back = lambda g: np.append(x.T @ g, g.sum())
    cost = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * strength
    cost, y = cost.astype(np.float32), y.astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    # the largest curvature bounds the step
    top = np.ones(x.shape[1] + 1, np.float32)
    for _ in range(12):
        top = back(cost * forth(top))
        size = np.linalg.norm(top)
        top /= size or 1.0
    # Python's floats, since numpy's double scalars would turn v, and x in each product, to doubles
    step, t = 1.0 / (1.0 + 2.0 * float(size)), 1.0
    for _ in range(steps):
        gap = np.maximum(0.0, 1.0 - y * forth(v))
        new = v - step * (v - 2.0 * back(cost * y * gap))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / t2 * (new - w), t2
    return w


@dataclass
class Model:
    families: list[str]
    top: np.ndarray  # a machine for each family against the rest
    languages: list[list[str]]  # of each family
    pairs: list[list[tuple[int, int]]]
    inner: list[np.ndarray]  # a machine for each pair of a family's languages
    rows: int = 0  # documents that it was fitted on

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = x @ self.top[:, :-1].T + self.top[:, -1]
        family = margin.argmax(axis=1)
        least = margin[np.arange(len(x)), family]
        lang = np.empty(len(x), object)
        for f, names in enumerate(self.languages):
            own = np.flatnonzero(family == f)
            if not len(own):
                continue
            best = np.zeros(len(own), np.int64)
            if len(names) > 1:
                d = x[own] @ self.inner[f][:, :-1].T + self.inner[f][:, -1]
                votes, sums = np.zeros((len(own), len(names))), np.zeros((len(own), len(names)))
                for k, (a, b) in enumerate(self.pairs[f]):
                    votes[:, a] += d[:, k] > 0
                    votes[:, b] += d[:, k] <= 0
                    sums[:, a] += d[:, k]
                    sums[:, b] -= d[:, k]
                best = (votes + 1e-3 * np.tanh(sums)).argmax(axis=1)
                for k, (a, b) in enumerate(self.pairs[f]):
                    toward = np.where(best == a, d[:, k], np.where(best == b, -d[:, k], np.inf))
                    least[own] = np.minimum(least[own], toward)
            lang[own] = np.array(names, object)[best]
        return lang, 1 / (1 + np.exp(-4 * np.clip(least, -10, 10)))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            part = part.take(pa.array(unseen(part.column(2), seen)))
            x, has = features(part.column(1).to_pylist())
            part = part.filter(pa.array(has))
            yield pa.record_batch({"lang": part.column(0), "key": part.column(2), "x": pa.array([v.tobytes() for v in x[has].astype(np.float16)], pa.binary())})


def fit(rows: pa.Table) -> Model | None:
    """The machines for a sample's features and labels, in the order of its keys."""
    rows = rows.sort_by("key")
    if not rows.num_rows:
        return None
    x = np.empty((rows.num_rows, BINS), np.float32)
    for k, v in enumerate(rows.column("x")):
        x[k] = np.frombuffer(v.as_buffer(), np.float16)
    lang = np.array(rows.column("lang").to_pylist())
    del rows
    family = np.array([FAMILY.get(k, "only " + k) for k in lang])
    families = sorted(set(family))
    top = np.stack([fit_svm(x, np.where(family == f, 1.0, -1.0)) for f in families]) if len(families) > 1 else np.ones((1, BINS + 1))
    languages = [sorted(set(lang[family == f])) for f in families]
    pairs = [list(combinations(range(len(names)), 2)) for names in languages]
    inner = []
    for names, both in zip(languages, pairs, strict=True):
        machines = []
        for a, b in both:
            own = (lang == names[a]) | (lang == names[b])
            machines.append(fit_svm(x[own], np.where(lang[own] == names[a], 1.0, -1.0)))
        inner.append(np.stack(machines) if machines else np.zeros((0, BINS + 1)))
    return Model(families, top.astype(np.float32), languages, pairs, [w.astype(np.float32) for w in inner], len(x))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of a sample that is one task's rows, as bytes."""
    held = list(batches)
    model = fit(pa.Table.from_batches(held)) if held else None
    if model:
        yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})


def train(docs: DataFrame, sample: int = SAMPLE, in_task: bool = False) -> Model | None:
    """The model of docs' labels, fitted here or, where the driver should not hold the sample, in one task."""
    known = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return None
    share = sample / len(counts)
    rate = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, share / n))]), F.col("lang"))
    chosen = known.select("lang", "text", F.xxhash64("doc_id", "text", F.lit(7)).alias("key")).where(F.pmod("key", F.lit(1 << 30)) < rate * F.lit(1 << 30))
    rows = few(chosen.mapInArrow(_sample, "lang string, key long, x binary"), 2 * sample)
    if not in_task:
        return fit(rows.toArrow())  # as Arrow, since rows as objects would be on the driver several times over
    model = rows.coalesce(1).mapInArrow(_fit, "model binary").first()
    return pickle.loads(model[0]) if model else None


def _predict(shared, keep: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("text"))
            _, offs = utf8(col)
            for a, b in slices(offs):
                for c in range(a, b, 256):
                    d = min(b, c + 256)
                    x, has = features([t or "" for t in col.slice(c, d - c).to_pylist()])
                    lang, score = np.full(d - c, "und", object), np.zeros(d - c)
                    if model and has.any():
                        lang[has], score[has] = model.predict(x[has])
                    part = batch.slice(c, d - c)
                    if keep is None:
                        yield pa.record_batch({"doc_id": part.column(0), "held_out": part.column(2), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(np.float64))})
                    else:
                        yield part.filter(pa.array((lang != "und") & (score >= keep)))

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(_predict(shared, None), "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, model: Model | None, least: float = 0.02) -> DataFrame:
    """The documents, all their columns, whose language is told with a score of `least` or more."""
    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), least), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op10: the language of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs, in_task=True))
