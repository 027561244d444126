"""Toxicity by compression distance.

Two zstandard dictionaries are trained with the library's trainer: one on ordinary text, one on toxic text.
Every window of a text, about ``WINDOW`` bytes cut at blanks, is compressed with each; the difference of the two
lengths says which kind of text explains the window better. The second compressor has the ordinary dictionary
behind the toxic one, so windows without toxic passages come out nearly equal.

Only a few words of a toxic document are toxic. A trainer that takes what is frequent would fill the toxic
dictionary with what all texts share, so it is trained on the toxic stretches of toxic documents: those whose
byte n-grams stand in so many more toxic than ordinary documents that chance can't explain it (``SURE``). Near
copies count as one document there. A document's features are counts and sums of its windows' differences above
calibrated thresholds (quantiles of ordinary windows); a logistic curve turns them into the score. Thresholds and
curve come from documents that the toxic dictionary in use was not trained on (``FOLDS`` parts, each scored with
the dictionary of the others), weighted to the classes' true shares among the labelled training documents.

Training takes a bounded number of the labelled documents (see ``train``), each with its whole text; scoring takes
whole texts, of any length. Null and empty texts have no windows and get the score of no evidence. Rows that
repeat an id are scored each. Labels that disagree for an id count as toxic if any does. Without documents of both
classes every score is 0. An empty table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table, text_of

WINDOW, DICT, TOXIC_DICT = 64, 32_768, 4_096
#: Lengths of the byte n-grams that find toxic stretches, bits of their hash tables, documents apart that score each other.
SIZES, BITS, FOLDS = (5, 8), 22, 3
#: An n-gram is toxic if its documents deviate from the classes' shares by so many nats of likelihood and so many times.
SURE, RATIO = 12.0, 8.0
#: Quantiles of ordinary windows' differences above which a window counts.
LEVELS = (0.9, 0.99, 0.999, 0.9999)
KEEP = 0.7


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of lower-cased texts; (n, 2) starts and lengths of windows; the text of each window."""
    data = [t.lower().encode() + b" " for t in texts]
    sizes = np.array([len(x) for x in data], np.int64)
    buf = np.frombuffer(b"".join(data), np.uint8)
    if not len(buf):
        return buf, np.empty((0, 2), np.int64), np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    blank = np.flatnonzero((buf == 32) | (buf == 10))
    marks = np.arange(WINDOW, len(buf), WINDOW)
    cuts = blank[np.minimum(np.searchsorted(blank, marks), len(blank) - 1)] + 1
    cuts = np.union1d(cuts, np.concatenate([[0], ends]))
    start, stop = cuts[:-1], cuts[1:]
    # a stretch without blanks is cut by length
    long = np.flatnonzero(stop - start > 8 * WINDOW)
    if len(long):
        more = [np.arange(start[i] + 4 * WINDOW, stop[i], 4 * WINDOW) for i in long]
        cuts = np.union1d(cuts, np.concatenate(more))
        start, stop = cuts[:-1], cuts[1:]
    return buf, np.stack([start, stop - start], 1), np.searchsorted(ends, start, side="right")


def _chunks(texts: list[str], size: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about ``size`` characters, so that arrays over their bytes stay small."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size or i == len(texts) - 1:
            yield texts[start : i + 1]
            start, total = i + 1, 0


class Lengths:
    """Compressed lengths of windows with one dictionary."""

    def __init__(self, content: bytes):
        p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=4, min_match=4, target_length=16, strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        self.c = zstandard.ZstdCompressor(dict_data=d, compression_params=p)

    def __call__(self, buf: np.ndarray, spans: np.ndarray) -> np.ndarray:
        if not len(spans):
            return np.empty(0, np.int64)
        segments = zstandard.BufferWithSegments(buf.tobytes(), np.ascontiguousarray(spans.astype(np.uint64)).tobytes())
        out = self.c.multi_compress_to_buffer(segments, threads=1)
        return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the samples; their bytes where there are too few to train on."""
    total = sum(map(len, samples))
    try:
        return zstandard.train_dictionary(max(256, min(size, total // 4)), samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def _hashes(raw: bytes, d: int) -> np.ndarray:
    """Of the d bytes from each place on."""
    buf = np.frombuffer(raw, np.uint8)
    if len(buf) < d:
        return np.empty(0, np.uint64)
    h = np.zeros(len(buf) - d + 1, np.uint64)
    for j in range(d):
        h *= np.uint64(0x100000001B3)
        h += buf[j : len(buf) - d + 1 + j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _cells(raw: bytes, d: int) -> np.ndarray:
    return (_hashes(raw, d) >> np.uint64(64 - BITS)).astype(np.int64)


def _sketch(raw: bytes) -> tuple[int, int]:
    """What near copies have in common: the smallest and the largest hash of 24 bytes."""
    h = _hashes(raw, min(24, max(1, len(raw))))
    return (int(h.min()), int(h.max())) if len(h) else (0, 0)


def toxic_cells(counts: list[np.ndarray], docs: np.ndarray) -> np.ndarray:
    """counts: by class, in how many documents each cell's n-grams stand; docs: documents by class. Which cells are toxic."""
    out, share, step = np.zeros(1 << BITS, bool), docs[1] / docs.sum(), 1 << 18
    for a in range(0, 1 << BITS, step):
        o, t = (c[a : a + step].astype(np.float64) for c in counts)
        n = o + t
        p = t / np.maximum(n, 1)
        surprise = n * (p * np.log(np.maximum(p, 1e-12) / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)))
        out[a : a + step] = (surprise >= SURE) & (t / docs[1] >= RATIO * (o + 0.5) / docs[0])
    return out


def stretches(raw: bytes, strong: dict[int, np.ndarray]) -> list[bytes]:
    """The stretches of a text that are covered by toxic n-grams."""
    edge = np.zeros(len(raw) + 1, np.int32)
    for d, cells in strong.items():
        at = np.flatnonzero(cells[_cells(raw, d)])
        edge[at] += 1
        edge[at + d] -= 1
    inside = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).view(np.int8), [0]])
    cut = np.flatnonzero(np.diff(inside))
    return [raw[a:e] for a, e in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True)]


def toxic_dictionaries(raws: list[bytes], toxic: np.ndarray, fold: np.ndarray) -> list[bytes]:
    """One trained on all toxic documents, then one for each fold, trained on those of the other folds."""
    docs = np.array([[np.sum((fold == f) & (toxic == c)) for c in (False, True)] for f in range(FOLDS)])
    strong: list[dict[int, np.ndarray]] = [{} for _ in range(FOLDS + 1)]
    for d in SIZES:
        counts = np.zeros((FOLDS, 2, 1 << BITS), np.uint16)
        for raw, c, f in zip(raws, toxic, fold, strict=True):
            counts[f, int(c), np.unique(_cells(raw, d))] += 1
        for f in range(-1, FOLDS):
            used = [g for g in range(FOLDS) if g != f]
            n = docs[used].sum(0)
            strong[f + 1][d] = toxic_cells([counts[used, c].sum(0, dtype=np.uint16) for c in (0, 1)], n) if n.all() else np.zeros(1 << BITS, bool)
        del counts
    out = []
    for f in range(-1, FOLDS):
        found = [stretches(raw, strong[f + 1]) for raw, c, g in zip(raws, toxic, fold, strict=True) if c and g != f]
        often = Counter(x for each in found for x in set(each))
        # the stretches that two documents have at least, document by document
        samples = [b" ".join(x for x in each if often[x] > 1) for each in found]
        out.append(trained(samples, TOXIC_DICT) if (samples := [x for x in samples if len(x) >= 8]) else b"")
    return out


class Model:
    def __init__(self, ordinary: bytes, toxic: bytes, limits: tuple[float, ...], weights: np.ndarray):
        self.ordinary, self.toxic, self.limits, self.weights, self._c = ordinary, toxic, limits, weights, None

    def __getstate__(self):
        return {**self.__dict__, "_c": None}

    def gains(self, buf: np.ndarray, spans: np.ndarray) -> np.ndarray:
        """By window: how much shorter the toxic dictionary makes it."""
        if not self.toxic:
            return np.zeros(len(spans), np.int64)
        if self._c is None:
            self._c = Lengths(self.ordinary), Lengths(self.toxic + self.ordinary)
        return self._c[0](buf, spans) - self._c[1](buf, spans)

    def features(self, texts: list[str]) -> np.ndarray:
        buf, spans, of = windows(texts)
        g, n = self.gains(buf, spans), len(texts)
        size = np.maximum(1, np.bincount(of, minlength=n))
        out = [np.ones(n), np.log(size), np.log1p(100 * np.maximum(0, np.bincount(of, g, n)) / size)]
        for x in self.limits:
            above = np.bincount(of, g > x, n)
            more = np.bincount(of, np.maximum(0, g - x), n)
            out += [np.log1p(above), np.log1p(100 * above / size), np.log1p(100 * more / size)]
        return np.stack(out, 1)

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (weight * p * (1 - p) + 1e-6)[:, None]) + 0.05 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
    return w


def fit(texts: list[str], toxic: np.ndarray, odds: float = 1.0) -> Model | None:
    """odds: how many ordinary documents there are for a toxic one, for calibration."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return None
    raws = [t.lower().encode() for t in texts]
    sketches = [_sketch(r) for r in raws]
    # near copies are in one fold, and only the first of them teaches
    fold = np.array([(a ^ b) % FOLDS for a, b in sketches])
    first = list(dict(zip(reversed(sketches), range(len(raws) - 1, -1, -1), strict=True)).values())
    pieces: list[bytes] = []
    for part in _chunks([texts[i] for i in first if not toxic[i]]):
        buf, spans, _ = windows(part)
        raw = buf.tobytes()
        pieces += [raw[a : a + n] for a, n in spans[::4].tolist()]
    ordinary = trained(pieces, DICT)
    del pieces
    dictionaries = toxic_dictionaries([raws[i] for i in first], toxic[first], fold[first])
    del raws
    folds = [Model(ordinary, d, (), np.zeros(0)) for d in dictionaries[1:]]
    base = []
    for f, m in enumerate(folds):
        for part in _chunks([texts[i] for i in first if fold[i] == f and not toxic[i]]):
            buf, spans, _ = windows(part)
            base.append(m.gains(buf, spans).astype(np.int16))
    base = np.concatenate(base or [np.zeros(1)])
    limits = tuple(sorted({float(max(0, np.quantile(base, q))) for q in LEVELS}))
    model = Model(ordinary, dictionaries[0], limits, np.zeros(0))
    x, y = [], []
    for f, m in enumerate(folds):
        m.limits, at = limits, np.flatnonzero(fold == f)
        x += [m.features(part) for part in _chunks([texts[i] for i in at])]
        y.append(toxic[at])
    y = np.concatenate(y)
    model.weights = _logistic(np.concatenate(x), y.astype(float), np.where(y, 1.0, odds * y.sum() / (~y).sum()))
    return model


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = 1500, ordinary_docs: int = 3000) -> Model | None:
    """From at most so many labelled documents of each class, those with the smallest hashes. Only labels of ``docs`` are counted."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    hash_ = F.xxhash64(F.lit(5), "doc_id").alias("h")
    # the ids are chosen without the texts; only the texts of the chosen ids, a bounded number, are read after that
    ids = docs.select("doc_id").join(marks, "doc_id").select("doc_id", "toxic", hash_)
    share = {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}
    if len(share) < 2:
        return None
    parts = []
    for of, n in ((False, ordinary_docs), (True, toxic_docs)):
        chosen = [r["doc_id"] for r in ids.where(F.col("toxic") == of).orderBy("h").limit(n).select("doc_id").distinct().collect()]
        rows = docs.where(F.col("doc_id").isin(chosen)).select(F.lit(of).alias("toxic"), "text", hash_)
        parts.append(rows.orderBy("h", "text").limit(n))
    texts, toxic = [], []
    for part in parts:
        for r in part.toLocalIterator():
            texts.append(r["text"] or "")
            toxic.append(r["toxic"])
    return fit(texts, np.array(toxic, bool), share[False] / share[True])


def toxicity(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per row of docs: doc_id, score."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = [shared.value.scores(part) for part in _chunks(b.column("text").to_pylist())]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.concatenate([np.empty(0), *got]))], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def held_out():
    """Rows that are not learnt from; a null id is learnt from like others, but has no label."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op1(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs.where(~held_out()), labels)
    return toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
