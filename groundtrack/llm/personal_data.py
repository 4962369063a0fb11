"""Personal data: fixed patterns, and spans that a character-level BiLSTM-CRF adds to them.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass its test. The
network reads characters in windows of WINDOW that overlap by half, around every word that holds a
digit, @ or a written-out (at) (a span of these kinds has one), gives each character scores for the tags O, B-kind and I-kind, and
is trained in numpy, on the driver, from labelled spans: base spans in about SAMPLE documents (never more than
twice as many, drawn by a hash of doc_id and text; equal ones count once), four windows of each (spread over the whole text), and copies of these windows in which
spans are written in other ways (cards with dots, phones without plus, (at) and [dot], and so on). The scores of overlapping windows are
averaged, each weighing by the distance from the window's edge, and one Viterbi pass with the CRF's
transitions over the whole stretch settles the tags, so a span that crosses windows comes out once.
Windows go through the network BATCH at a time; a stretch that goes on in the next batch hands over
its open scores and Viterbi's state, so a very long text needs a few bytes a character.

A decoded span is added if it overlaps no base span and holds what its kind needs (an address with
@ or (at) and a dotted host; four numbers up to 255; 13 to 19 digits passing Luhn; 9 to 15 digits with
separators). Null text counts as empty and has no spans. Rows that repeat a doc_id each give a row;
columns other than doc_id and text are not read. An empty table gives no rows; of matches that begin at one
place the pattern takes the longest. Without spans to learn from nothing is added.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundtrack.llm.common import few, share_of, slices, unseen, utf8

KINDS = ("email", "ip", "card", "phone")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)
WINDOW, MARGIN, HIDDEN = 64, 24, 16
#: Windows in the network at once.
BATCH = 512
SAMPLE = 1200

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]|[(\[]at[)\]]")
_WORD = re.compile(r"\S+")
_AT = re.compile(r"\s*[(\[](?:at|@)[)\]]\s*")
_DOT = re.compile(r"\s*[(\[](?:dot|\.)[)\]]\s*")
_DIGITS = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def _small(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start. Each pass is linear in the text."""
    out, done, p = [], 0, text.find("@")
    while p >= 0:
        s = p
        while s > done and text[s - 1] in _LOCAL:
            s -= 1
        m = _HOST.match(text, p + 1) if s < p else None
        if m:
            out.append(("email", s, m.end()))
            done = m.end()
        p = text.find("@", max(p + 1, done))
    if not _ANCHOR.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _small(m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether a decoded span holds what its kind needs."""
    if kind == "email":
        local, _, host = _DOT.sub(".", _AT.sub("@", s)).partition("@")
        return bool(local) and "." in host.strip(".") and not re.search(r"\s", local + host) and "@" not in host
    d = _digits(s)
    if kind == "ip":
        parts = _DIGITS.findall(s)
        return len(parts) == 4 and _small(parts) and len(s) <= len(d) + 12
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d) and len(s) <= 2 * len(d) and not re.search(r"[A-Za-z]", s)
    return 9 <= len(d) <= 15 and len(_DIGITS.findall(s)) >= 3 and len(s) <= 2 * len(d) and not re.search(r"[A-Za-z]", s)


# ---------------------------------------------------------------- network


def codes(text: str) -> np.ndarray:
    """Printable ASCII as itself, then line feed, other letters, all else; 0 is padding."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where((x >= 32) & (x < 127), x - 31, np.where(x == 10, 96, np.where(x >= 0xC0, 97, 98)))


VOCABULARY = 99


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


_BAN = np.where(_allowed(), 0.0, -1e4)


def _sig(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(ids: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool = False):
    n, steps, size = ids.shape[0], ids.shape[1], wh.shape[0]
    h, c = np.zeros((n, size)), np.zeros((n, size))
    out, past = np.empty((n, steps, size)), []
    for t in range(steps):
        z = wx[ids[:, t]] + h @ wh + b
        g = _sig(z[:, : 3 * size])
        i, f, o, u = g[:, :size], g[:, size : 2 * size], g[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before = (h, c)
        c = f * c + i * u
        tc = np.tanh(c)
        h = o * tc
        out[:, t] = h
        if keep:
            past.append((i, f, o, u, tc, *before))
    return out, past


def _lstm_back(ids: np.ndarray, wh: np.ndarray, past: list, dout: np.ndarray):
    size = wh.shape[0]
    dwx, dwh, db = np.zeros((VOCABULARY, 4 * size)), np.zeros_like(wh), np.zeros(4 * size)
    dh, dc = np.zeros((len(ids), size)), np.zeros((len(ids), size))
    for t in range(ids.shape[1] - 1, -1, -1):
        i, f, o, u, tc, h0, c0 = past[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * u * i * (1 - i), dc * c0 * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=1)
        np.add.at(dwx, ids[:, t], dz)
        dwh += h0.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ wh.T, dc * f
    return dwx, dwh, db


def _crf_gradient(e: np.ndarray, trans: np.ndarray, tags: np.ndarray):
    """Gradients of the mean negative log-likelihood by scores and transitions."""
    n, steps, k = e.shape
    a = trans + _BAN
    top = lambda x, axis: x.max(axis=axis, keepdims=True)

    def lse(x, axis):
        m = top(x, axis)
        return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))

    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, steps):
        alpha[:, t] = e[:, t] + lse(alpha[:, t - 1][:, :, None] + a, 1)
    for t in range(steps - 2, -1, -1):
        beta[:, t] = lse(a + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    z = lse(alpha[:, -1], 1)
    de = np.exp(alpha + beta - z[:, None, None])
    pair = np.zeros((k, k))
    for t in range(1, steps):
        pair += np.exp(alpha[:, t - 1][:, :, None] + a + (e[:, t] + beta[:, t])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(pair, (tags[:, t - 1], tags[:, t]), -1)
    de[np.arange(n)[:, None], np.arange(steps)[None, :], tags] -= 1
    return de / n, pair / n


@dataclass
class Network:
    p: dict[str, np.ndarray]

    @classmethod
    def start(cls, seed: int = 4) -> Network:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p |= {"x" + d: r.normal(0, 0.1, (VOCABULARY, 4 * HIDDEN)), "h" + d: r.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "b" + d: np.zeros(4 * HIDDEN)}
            p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        return cls(p | {"o": r.normal(0, 0.1, (2 * HIDDEN, TAGS)), "bo": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))})

    def scores(self, ids: np.ndarray, keep: bool = False):
        p = self.p
        f, pf = _lstm(ids, p["xf"], p["hf"], p["bf"], keep)
        b, pb = _lstm(ids[:, ::-1], p["xb"], p["hb"], p["bb"], keep)
        h = np.concatenate([f, b[:, ::-1]], axis=2)
        return h @ p["o"] + p["bo"], h, pf, pb

    def gradient(self, ids: np.ndarray, tags: np.ndarray) -> dict[str, np.ndarray]:
        e, h, pf, pb = self.scores(ids, True)
        de, dt = _crf_gradient(e, self.p["t"], tags)
        dh = de @ self.p["o"].T
        g = {"t": dt, "o": np.einsum("ntk,nts->ks", h, de), "bo": de.sum(axis=(0, 1))}
        g["xf"], g["hf"], g["bf"] = _lstm_back(ids, self.p["hf"], pf, dh[:, :, :HIDDEN])
        g["xb"], g["hb"], g["bb"] = _lstm_back(ids[:, ::-1], self.p["hb"], pb, dh[:, ::-1, HIDDEN:])
        return g

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int = 260, batch: int = 48, seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in "mv")
        for t in range(1, steps + 1):
            at = r.integers(0, len(ids), batch)
            rate = 0.02 * min(1.0, 2 * (1 - t / (steps + 1)))
            for k, g in self.gradient(ids[at], tags[at]).items():
                g = np.clip(g, -1, 1)
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray, now: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Best score of each tag at the end of one more piece of a stretch, and the way back."""
        a, back = self.p["t"] + _BAN, np.zeros(e.shape, np.int8)
        for t in range(len(e)):
            if now is None:
                now = e[0] + _BAN[0]
                continue
            step = now[:, None] + a
            back[t] = step.argmax(axis=0)
            now = step.max(axis=0) + e[t]
        return now, back


def way_back(now: np.ndarray, backs: list[np.ndarray]) -> np.ndarray:
    """Best tags of a whole stretch, from its last scores and the ways back of its pieces."""
    tags, tag = [], int(now.argmax())
    for back in reversed(backs):
        own = np.empty(len(back), np.int8)
        for t in range(len(back) - 1, -1, -1):
            own[t] = tag
            tag = int(back[t, tag])
        tags.append(own)
    return np.concatenate(tags[::-1])


def stretches(text: str) -> list[tuple[int, int]]:
    """Stretches of text around words with a digit, @ or (at)."""
    out: list[list[int]] = []
    if not _ANCHOR.search(text):
        return []
    for m in _WORD.finditer(text):
        if _ANCHOR.search(m.group()):
            a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
            if out and a <= out[-1][1]:
                out[-1][1] = b
            else:
                out.append([a, b])
    return [tuple(x) for x in out]


def _tags_to_spans(tags: np.ndarray, at: int) -> list[tuple[str, int, int]]:
    out, i = [], 0
    while i < len(tags):
        if tags[i] % 2 == 1:
            j = i + 1
            while j < len(tags) and tags[j] == tags[i] + 1:
                j += 1
            out.append((KINDS[(tags[i] - 1) // 2], at + i, at + j))
            i = j
        else:
            i += 1
    return out


def decode(network: Network, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans that the network sees in each text, before they are held against the base spans."""
    half, out = WINDOW // 2, [[] for _ in texts]
    parts = [(d, a, b) for d, t in enumerate(texts) for a, b in stretches(t)]
    counts = np.array([max(1, -(-(b - half - a) // half)) for _, a, b in parts], np.int64)
    upto = np.cumsum(counts)
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(float)[:, None]
    open_sum, open_mass = np.zeros((half, TAGS)), np.zeros((half, 1))  # of places that the next window reaches as well
    now, backs = None, []
    for i in range(0, int(upto[-1]) if len(parts) else 0, BATCH):
        index = np.arange(i, min(i + BATCH, int(upto[-1])))
        part = np.searchsorted(upto, index, "right")
        nth = index - (upto[part] - counts[part])
        ids = np.zeros((len(index), WINDOW), np.int64)
        for w, (k, x) in enumerate(zip(part, nth, strict=True)):
            d, a, b = parts[k]
            seen = codes(texts[d][a + x * half : min(b, a + x * half + WINDOW)])
            ids[w, : len(seen)] = seen
        scores = network.scores(ids)[0]
        for k in np.unique(part):
            d, a, b = parts[k]
            own = np.flatnonzero(part == k)
            total, mass = np.zeros((half * (len(own) + 1), TAGS)), np.zeros((half * (len(own) + 1), 1))
            if nth[own[0]]:
                total[:half], mass[:half] = open_sum, open_mass
            for n, w in enumerate(own):
                total[n * half : n * half + WINDOW] += scores[w] * weight
                mass[n * half : n * half + WINDOW] += weight
            begin = int(nth[own[0]]) * half
            done = nth[own[-1]] + 1 == counts[k]
            size = b - a - begin if done else half * len(own)
            open_sum, open_mass = total[-half:], mass[-half:]
            now, back = network.viterbi(total[:size] / mass[:size], now)
            backs.append(back)
            if done:
                out[d] += _tags_to_spans(way_back(now, backs), a)
                now, backs = None, []
    return out


def added_spans(network: Network | None, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    if network is None:
        return [[] for _ in texts]
    out = []
    for text, known, found in zip(texts, base, decode(network, texts), strict=True):
        taken = np.zeros(len(text) + 1, bool) if found else None
        for _, a, b in known if found else ():
            taken[a:b] = True
        out.append([(k, a, b) for k, a, b in found if not taken[a:b].any() and plausible(k, text[a:b])])
    return out


# ---------------------------------------------------------------- training


def windows_of(text: str, most: int = 4) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Up to `most` windows around base spans or other digits, with the spans that lie in them, from
    stretches spread evenly over the whole text; the beginning of a stretch longer than a window."""
    spans, out, found = base_spans(text), [], stretches(text)
    for a, _ in found[:: max(1, len(found) // (8 * most))]:
        s = max(0, min(a, len(text) - WINDOW))
        e = s + WINDOW
        inside = [(k, x - s, y - s) for k, x, y in spans if s <= x and y <= e]
        if not any(x < e < y or x < s < y for _, x, y in spans):
            out.append((text[s:e], inside))
        if len(out) == most:
            break
    return out


def rewritten(window: str, spans: list, r: np.random.Generator) -> tuple[str, list] | None:
    """The window with a span written in another way, cut to its length."""
    if not spans:
        return None
    k, a, b = spans[int(r.integers(len(spans)))]
    d = _digits(window[a:b])
    if k == "card":
        sep = str(r.choice([".", "_", " ", "-", "  "]))
        new = sep.join(d[i : i + 4] for i in range(0, len(d), 4))
    elif k == "phone":
        area, mid, end = d[-10:-7], d[-7:-4], d[-4:]
        new = str(r.choice([f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"00{d[:-10]} {area} {mid} {end}", f"{area} {mid} {end}"]))
    elif k == "ip":
        new = window[a:b].replace(".", str(r.choice(["[.]", "(.)", " . "])))
    else:
        local, _, host = window[a:b].partition("@")
        sign = str(r.choice(["(at)", "[at]", " (at) ", " [at] ", "@"]))
        dot = str(r.choice([".", "(dot)", "[dot]", " [dot] "]))
        if sign == "@":
            local, dot = local.translate({ord(x): y for x, y in zip("aeou", "áèöü", strict=True)}), "."
        new = local + sign + host.replace(".", dot)
    text = (window[:a] + new + window[b:])[:WINDOW]
    if a + len(new) > WINDOW:
        return None
    shift = len(new) - (b - a)
    moved = [(kk, x + shift, y + shift) if x >= b else (kk, x, y) for kk, x, y in spans if (x, y) != (a, b)]
    if any(y > WINDOW for _, _, y in moved):
        return None
    return text, [*moved, (k, a, a + len(new))]


def examples(windows: list[tuple[str, list]], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    every = list(windows)
    for w in windows:
        if x := rewritten(*w, r):
            every.append(x)
    ids, tags = np.zeros((len(every), WINDOW), np.int64), np.zeros((len(every), WINDOW), np.int64)
    for i, (text, spans) in enumerate(every):
        x = codes(text)
        ids[i, : len(x)] = x
        for k, a, b in spans:
            t = 1 + 2 * KINDS.index(k)
            tags[i, a:b] = t + 1
            tags[i, a] = t
    return ids, tags


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        batch = batch.take(pa.array(unseen(batch.column(1), seen)))
        cuts = [windows_of(t) for t in batch.column(0).to_pylist()]
        made = [[{"window": w, "spans": ",".join(f"{k}:{a}:{b}" for k, a, b in s)} for w, s in x] for x in cuts]
        yield pa.record_batch({"key": batch.column(1), "windows": pa.array(made, pa.list_(pa.struct([("window", pa.string()), ("spans", pa.string())])))})


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").rlike(_ANCHOR.pattern))
    n = some.count()
    if not n:
        return None
    key = F.xxhash64("doc_id", "text")
    drawn = some.where(share_of(key, sample / n, 13)).select("text", key.alias("key"))
    rows = few(drawn.mapInArrow(_sampled, "key long, windows array<struct<window string, spans string>>"), 2 * sample).collect()
    found = sorted((w, s) for r in rows for w, s in r.windows)
    windows = [(w, [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in s.split(",") if x)]) for w, s in found]
    if not any(s for _, s in windows):
        return None
    return Network.start().fit(*examples(windows))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def _few(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about a slice's bytes, of at most 256 rows."""
    for a, b in slices(offs):
        yield from ((x, min(x + 256, b)) for x in range(a, b, 256))


def _found(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            for at, end in _few(utf8(batch.column(1))[1]):
                part = batch.slice(at, end - at)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(network, texts, base)
                columns = {"doc_id": part.column(0)}
                columns |= {"n_" + k: pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS}
                columns |= {"base": pa.array([_joined(x) for x in base]), "spans": pa.array([_joined([*x, *y]) for x, y in zip(base, more, strict=True)])}
                yield pa.record_batch(columns)

    return run


def find(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, the number of base spans of each kind, base and spans as kind:start:end joined."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_found(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: personal data of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find(docs, train(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
