"""Language identification with interpolated Kneser-Ney character models.

Letters are lower-cased and everything else is a boundary between words; each word, with a
boundary on both sides, is scored by a model of order ``ORDER`` for each language. Discounts come
from the counts of counts; lower orders use continuation counts; the lowest is interpolated with
the uniform distribution. All interpolation is done in training: for every n-gram that any
language knows a table holds its hash, sorted, with the finished log-probability of each
language, and for every context its back-off weight. Scoring looks up the longest n-gram,
then shorter ones; every distinct word of a batch is scored once.

A text gets the language of the lowest cross-entropy a character. Its score is the posterior
of that language among all, flattened by a temperature that is calibrated on training texts, and
lowered where the cross-entropy lies above what the language's own texts have (rejection: such a
text is in none of them). ``reject`` turns low scores into ``und``; how far above is unusual, and the least score that
is usual, come from the training texts too.

Training takes a bounded sample: of each language about ``chars`` characters, from the documents
with the smallest hashes. Null texts and texts without a letter get ``und`` and score 0. Rows that repeat an id are
predicted each. Without training texts, and so for an empty table, every prediction is ``und``; columns other than
id, text and (in training) lang are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ship, table

ORDER = 5
#: Pieces of each language that calibrate.
CALIBRATE = 1000
MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x10000)])


def to_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points (0 between words), starts and lengths of the words, and the text of each."""
    texts = [t.lower() for t in texts]
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    low = points < 0x10000
    is_letter = _letters()[np.where(low, points, 0)]
    if not low.all():
        for c in np.unique(points[~low]).tolist():
            if chr(c).isalpha():
                is_letter = is_letter | (points == c)
    points = np.where(is_letter, points, 0).astype(np.uint32)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_letter.view(np.int8), [0]])))
    start, stop = edge[::2], edge[1::2]
    return points, start, stop - start, np.searchsorted(np.cumsum(sizes), start, side="right")


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ (c.astype(np.uint64, copy=False) + np.uint64(1))) * MIX
    return h ^ (h >> np.uint64(29))


class Grams:
    """The n-grams that end at each character of the words and at the boundary after them."""

    def __init__(self, points: np.ndarray, start: np.ndarray, length: np.ndarray):
        total = int((length + 1).sum())
        self.word = np.repeat(np.arange(len(start)), length + 1)
        first = np.cumsum(length + 1) - (length + 1)
        self.within = np.arange(total) - np.repeat(first, length + 1)
        # the words with a boundary after each, then shifted copies; what lies before the word is a boundary
        flat = np.where(self.within < np.repeat(length, length + 1), points[np.minimum(np.repeat(start, length + 1) + self.within, len(points) - 1)], 0).astype(np.uint64)
        self.chars = [flat]
        for back in range(1, ORDER):
            c = np.zeros(total, np.uint64)
            c[back:] = flat[:-back] if back < total else 0
            c[self.within < back] = 0
            self.chars.append(c)

    def hashes(self, n: int, at: np.ndarray | slice, context: bool = False) -> np.ndarray:
        """Of the n-gram (or the n - 1 characters before its last); 0 where it would begin before the word's boundary."""
        within = self.within[at]
        h = np.full(len(within), n, np.uint64) * MIX
        for back in range(n - 1, 0 if context else -1, -1):
            h = _mix(h, self.chars[back][at])
        h[within - (n - 1) < -1] = 0
        return h


class Model:
    """langs; per order: sorted n-gram hashes with log-probabilities, sorted context hashes with log back-off weights (languages in columns)."""

    def __init__(self, langs: list[str], grams_, contexts, floor: np.ndarray):
        self.langs, self.grams, self.contexts, self.floor = langs, grams_, contexts, floor
        #: Calibrated in ``fit``: temperature; mean and spread of each language's own cross-entropy; how many spreads above
        #: are usual; the least score that texts of a language have.
        self.heat, self.usual, self.far, self.least = 1.0, np.zeros((len(langs), 2)), 6.0, 0.0

    def word_logs(self, points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(words, languages) sums of log-probabilities."""
        g = Grams(points, start, length)
        word, n, k = g.word, len(g.word), len(self.langs)
        out, open_ = np.zeros((n, k)), np.arange(n)
        for order in range(ORDER, 0, -1):
            for context in (False, True):
                keys, logs = (self.contexts if context else self.grams)[order - 1]
                if not len(keys) or not len(open_):
                    continue
                h = g.hashes(order, open_, context)
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = (keys[at] == h) & (h != 0)
                out[open_[hit]] += logs[at[hit]]
                if not context:
                    open_ = open_[~hit]
        out[open_] += self.floor
        return np.stack([np.bincount(word, out[:, j], len(start)) for j in range(k)], 1)

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) mean cross-entropy a character in nats, and the number of characters with boundaries."""
        points, start, length, of = to_words(texts)
        n, k = len(texts), len(self.langs)
        if not len(start):
            return np.zeros((n, k)), np.zeros(n)
        # equal words once: two hashes of their letters by sums over a weighted prefix
        total = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(total[-1]) - np.repeat(total[:-1], length)
        letters = points[np.repeat(start, length) + place].astype(np.uint64)
        h = _mix(_mix(np.full(len(letters), 7, np.uint64), letters), place)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)])
        key = sums[total[1:]] - sums[total[:-1]]
        _, first, same = np.unique(key, return_index=True, return_inverse=True)
        logs = self.word_logs(points, start[first], length[first])
        chars = np.bincount(of, length + 1, n)
        sums = np.stack([np.bincount(of, logs[same, j], n) for j in range(k)], 1)
        return -sums / np.maximum(chars, 1)[:, None], chars

    def predict(self, texts: list[str], reject: float | None = 0.0) -> tuple[list[str], np.ndarray]:
        """reject: the least score of a language; None takes the calibrated one."""
        reject = self.least if reject is None else reject
        texts = [t or "" for t in texts]
        h, chars = self.entropies(texts)
        best = h.argmin(1)
        bits = -(h - h.min(1)[:, None]) * np.sqrt(np.maximum(chars, 1))[:, None] * self.heat
        score = 1 / np.exp(bits).sum(1)
        mean, spread = self.usual[best, 0], self.usual[best, 1]
        # shorter texts than the calibration's pieces spread more
        spread = spread * np.sqrt(np.maximum(1, 200 / np.maximum(chars, 1)))
        over = np.maximum(0, (h.min(1) - mean) / np.maximum(spread, 1e-3) / self.far - 1)
        score = np.where(chars > 0, score / (1 + over), 0.0)
        return [self.langs[b] if c and s >= reject else "und" for b, c, s in zip(best.tolist(), chars.tolist(), score.tolist(), strict=True)], score


def _counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per order: distinct n-gram hashes, raw counts, hashes of their contexts, hashes of their suffixes."""
    points, start, length, _ = to_words(texts)
    g, out = Grams(points, start, length), []
    for n in range(1, ORDER + 1):
        h = g.hashes(n, slice(None))
        ok = np.flatnonzero(h != 0)
        keys, first, count = np.unique(h[ok], return_index=True, return_counts=True)
        at = ok[first]
        out.append((keys, count.astype(float), g.hashes(n, at, True), g.hashes(n - 1, at) if n > 1 else np.zeros(len(keys), np.uint64)))
    return out


def fit(samples: dict[str, list[str]]) -> Model | None:
    langs = sorted(samples)
    if not langs:
        return None
    counts = {x: _counts(samples[x]) for x in langs}
    alphabet = max(2, len(np.unique(np.concatenate([counts[x][0][0] for x in langs]))) + 1)
    uniform = 1 / alphabet
    grams_, contexts, lower = [], [], None
    for n in range(ORDER):
        every = np.unique(np.concatenate([counts[x][n][0] for x in langs]))
        places = np.unique(np.concatenate([counts[x][n][2] for x in langs]))
        p, backs = np.zeros((len(every), len(langs))), np.ones((len(places), len(langs)))
        context_of, suffix_of = np.zeros(len(every), np.uint64), np.zeros(len(every), np.uint64)
        for j, x in enumerate(langs):
            keys, count, ctx, suffix = counts[x][n]
            at = np.searchsorted(every, keys)
            context_of[at], suffix_of[at] = ctx, suffix
            if n < ORDER - 1:
                # continuation counts: in how many longer n-grams it is the suffix; n-grams at a word's start keep their raw count
                more = counts[x][n + 1]
                kinds, follow = np.unique(more[3], return_counts=True)
                hit = np.minimum(np.searchsorted(kinds, keys), max(0, len(kinds) - 1))
                count = np.where(kinds[hit] == keys, follow[hit], count) if len(kinds) else count
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            d = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
            where = np.searchsorted(places, ctx)
            sums = np.bincount(where, count, len(places))
            kinds = np.bincount(where, minlength=len(places))
            backs[:, j] = np.where(sums > 0, d * kinds / np.maximum(sums, 1e-9), 1.0)
            p[at, j] = np.maximum(count - d, 0) / sums[where]
        if n == 0:
            below = np.full((len(every), len(langs)), uniform)
        else:
            at = np.searchsorted(grams_[n - 1][0], suffix_of)
            below = np.exp(grams_[n - 1][1][np.minimum(at, len(grams_[n - 1][0]) - 1)])
        p += backs[np.searchsorted(places, context_of)] * below
        grams_.append((every, np.log(p)))
        contexts.append((places, np.log(backs)))
    model = Model(langs, grams_, contexts, np.full(len(langs), np.log(uniform)))
    # calibration on pieces of the training texts: spread of the own cross-entropy, then the temperature
    pieces, own, far, whole_ = [], [], [3.0], []
    for j, x in enumerate(langs):
        whole = " ".join(samples[x])
        # pieces all over the sample, CALIBRATE of each kind at most
        cut = [whole[i : i + 200] for i in range(0, len(whole), max(200, len(whole) // CALIBRATE))]
        h, chars = model.entropies(cut)
        own_h = h[chars > 0, j]
        model.usual[j] = (own_h.mean(), own_h.std()) if len(own_h) else (0, 1)
        if len(own_h):
            far.append(float(np.quantile((own_h - own_h.mean()) / max(own_h.std(), 1e-3), 0.999)))
        whole_ += cut
        pieces += [whole[i : i + 24] for i in range(0, len(whole), max(24, len(whole) // CALIBRATE))]
        own += [j] * (len(pieces) - len(own))
    h, chars = model.entropies(pieces)
    own = np.array(own)
    gap = -(h - h.min(1)[:, None]) * np.sqrt(np.maximum(chars, 1))[:, None]
    heats = np.array([0.25, 0.5, 1, 2, 4, 8])
    loss = [-np.mean((gap * t)[np.arange(len(own)), own] - np.log(np.exp(gap * t).sum(1))) for t in heats]
    model.heat, model.far = float(heats[int(np.argmin(loss))]), max(far)
    scores = model.predict(whole_)[1]
    model.least = float(np.quantile(scores[scores > 0], 0.001)) if (scores > 0).any() else 0.0
    return model


def train(docs: DataFrame, chars: int = 400_000) -> Model | None:
    """From texts with a language: of each, documents by smallest hash until there are ``chars`` characters, one at least."""
    hash_ = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(3), "text")).otherwise(F.xxhash64(F.lit(3), "doc_id"))
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text", hash_.alias("h"))
    sizes = rows.select("lang", "h", F.length("text").alias("n"))
    totals = sizes.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    # of each language so large a share that it very likely has the characters; more where it has not
    share = {r["lang"]: min(1.0, 1.5 * chars / max(1, r["n"]) + 20 / r["k"]) for r in totals}
    last: dict[str, int] = {}
    while share:
        some = F.lit(False)
        for lang, x in share.items():
            some = some | ((F.col("lang") == lang) & (F.col("h") / 2.0**64 + 0.5 <= x))
        got = sizes.where(some).toArrow().to_pylist()
        for lang in list(share):
            total = 0
            for r in sorted((r for r in got if r["lang"] == lang), key=lambda r: r["h"]):
                total, last[lang] = total + r["n"], r["h"]
                if total >= chars:
                    break
            if total >= chars or share[lang] >= 1:
                del share[lang]
            else:
                share[lang] = min(1.0, 4 * share[lang])
    keep = F.lit(False)
    for lang, h in last.items():
        keep = keep | ((F.col("lang") == lang) & (F.col("h") <= h))
    got = rows.where(keep).select("lang", "text").toArrow().to_pylist()
    samples: dict[str, list[str]] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return fit(samples)


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text", reject: float | None = 0.0) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts, start, chars = b.column("text").to_pylist(), 0, 0
            for i in range(len(texts) + 1):
                if i == len(texts) or chars > 3_000_000:
                    langs, scores = shared.value.predict(texts[start:i], reject)
                    yield pa.record_batch([b.column("doc_id").slice(start, i - start), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])
                    start, chars = i, 0
                if i < len(texts):
                    chars += len(texts[i] or "")

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out():
    """Rows that are not learnt from; a null id is learnt from like others."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
