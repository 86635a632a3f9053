"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Texts become lower-case letters (with their combining marks) and one blank between words. Their 1- to 3-grams go to 2**BITS
hashed features; a feature's value is its share of the text's n-grams times its inverse document
frequency. Weights are trained by follow-the-regularised-leader with elastic-net penalties, which leaves
most of them exactly 0, and a temperature is fitted on rows kept apart from training. Values enter a
score linearly, so prediction adds up one row of a table for each n-gram of the whole text.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import held_out, map_arrow, read_table

#: Documents that a model is fitted on at most: those whose hashed ids come first.
SAMPLE = 6_000
#: log2 of features; longest n-gram.
BITS, LONGEST = 16, 3
#: FTRL: rate, smoothing, L1 and L2 penalties; passes over the sample; scale of feature values.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.3, 1.0, 0.2, 1.0, 3, 10.0
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For each code point: its lower-case letter, itself for a combining mark, or a blank."""
    points = np.full(0x110000, 32, np.uint32)
    for p in range(0x30000):
        if not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p))[0] in "LM":
            low = chr(p).lower()
            points[p] = ord(low) if len(low) == 1 else p
    points[0x30000:0x33480] = np.arange(0x30000, 0x33480)
    return points


@cache
def _marks() -> np.ndarray:
    """Whether each code point is a combining mark: those alone are no letters."""
    marks = np.zeros(0x110000, bool)
    for p in range(0x20000):
        marks[p] = not 0xD800 <= p <= 0xDFFF and unicodedata.category(chr(p))[0] == "M"
    marks[0xE0100:0xE01F0] = True
    return marks


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters and single blanks, one text after the other, and where each begins; a text begins and ends with a blank."""
    raw = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    blank = np.full(1, 32, np.uint32)
    parts = [p for r in raw for p in (blank, r, blank)]
    whole = _letters()[np.concatenate(parts)] if parts else np.empty(0, np.uint32)
    ends = np.cumsum([len(r) + 2 for r in raw]).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(raw) else np.empty(0, np.int64)
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != 32) | (whole[:-1] != 32)
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return whole[keep], before[starts]


def ngrams(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all n-grams, and of each text its first n-gram and their number. n-grams don't cross texts; a blank alone is none."""
    n, of = len(points), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    hashes, owners = [], []
    h = np.zeros(n, np.uint64)
    for size in range(1, LONGEST + 1):
        if n < size:
            break
        h = h[: n - size + 1] * np.uint64(0x9E3779B97F4A7C15) + points[size - 1 :].astype(np.uint64) + np.uint64(size)
        ok = of[: n - size + 1] == of[size - 1 :]
        if size == 1:
            ok &= points != 32
        hashes.append((((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS))[ok].astype(np.int64))
        owners.append(of[: n - size + 1][ok])
    if not hashes:
        return np.empty(0, np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(starts))
    return np.concatenate(hashes)[order], np.cumsum(counts) - counts, counts


def has_letter(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    return np.bincount(of, (points != 32) & ~_marks()[points], len(starts)) > 0


class LanguageModel:
    """Languages, table of weights (feature by language, inverse document frequency included), bias and temperature."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, str]]):
        """rows: distinct features, their counts and the language of each document, in a fixed order."""
        self.languages = sorted({lang for _, _, lang in rows})
        k, size = len(self.languages), 2**BITS
        self.temperature, self.bias = 1.0, np.zeros(max(k, 1), np.float32)
        self.table = np.zeros((size, max(k, 1)), np.float32)
        if k < 2:
            return
        frequency = np.zeros(size)
        for f, _, _ in rows:
            frequency[f] += 1
        idf = np.log((1 + len(rows)) / (1 + frequency)) + 1
        of = {lang: j for j, lang in enumerate(self.languages)}
        data = [(f, SCALE * idf[f] * c / c.sum(), of[lang]) for f, c, lang in rows]
        kept, apart = [d for j, d in enumerate(data) if j % 10], data[::10]
        z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

        def weights(f: np.ndarray) -> np.ndarray:
            zf = z[f]
            return np.where(np.abs(zf) <= L1, 0.0, -(zf - np.sign(zf) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

        for _ in range(PASSES):
            for f, v, y in kept:
                f, v = np.append(f, size), np.append(v, 1.0)  # the last feature is the bias
                w = weights(f)
                s = v @ w
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g = v[:, None] * p
                sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA
                z[f] += g - sigma * w
                n[f] += g * g
        w = weights(np.arange(size + 1))
        self.nonzero = float((w[:size] != 0).mean())
        self.bias = w[size].astype(np.float32)
        self.table = (SCALE * idf[:, None] * w[:size]).astype(np.float32)
        logits = np.array([self.bias + v @ w[f] for f, v, _ in apart])
        truth = np.array([y for _, _, y in apart])
        temperatures = np.geomspace(0.05, 20, 121)
        loss = []
        for t in temperatures:
            s = logits / t
            s = s - s.max(axis=1, keepdims=True)
            loss.append(float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(truth)), truth])))
        self.temperature = float(temperatures[int(np.argmin(loss))])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated probability; UNKNOWN with 0 where a text has no letter or nothing was learned."""
        points, starts = letters(texts)
        some = has_letter(points, starts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        grams, first, counts = ngrams(points, starts)
        total = np.zeros((len(texts), self.table.shape[1]))
        full = np.flatnonzero(counts)
        if len(full):
            total[full] = np.add.reduceat(self.table[grams], first[full], axis=0)
        logits = (total / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, some)], np.where(some, p[np.arange(len(best)), best], 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """A model of at most `sample` documents that are not held out and have a language and a letter.

    The documents are those whose ids come first by a hash; of several rows of an id one counts, the
    smallest by language and n-grams. Whole texts become counts of n-grams on the executors, and only
    the chosen documents' counts, at most 2**BITS each, reach the driver.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    chosen = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        points, starts = letters(batch.column(2).to_pylist())
        grams, first, counts = ngrams(points, starts)
        f, c = [], []
        for a, n in zip(first.tolist(), counts.tolist()):
            one, many = np.unique(grams[a : a + n], return_counts=True)
            f.append(one.astype(np.int32))
            c.append(many.astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(f, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int32()))], names=["doc_id", "lang", "f", "c"])

    counted = map_arrow(rows.join(F.broadcast(chosen), "doc_id", "left_semi").select("doc_id", "lang", "text"), of, f"doc_id {dict(rows.dtypes)['doc_id']}, lang string, f array<int>, c array<int>").where("size(f) > 0")
    one = counted.groupBy("doc_id").agg(F.min(F.struct("lang", F.size("f").alias("n"), "f", "c")).alias("row")).select("doc_id", "row.lang", "row.f", "row.c")
    table = one.toArrow().to_pylist()
    table.sort(key=lambda r: str(r["doc_id"])[::-1])  # a fixed order that mixes the ids
    return LanguageModel([(np.array(r["f"], np.int64), np.array(r["c"], float), r["lang"]) for r in table])


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred string, score double) for every row of docs.

    Whole texts are read, however long; other columns are not, whatever their names. Null texts and
    texts without a letter are UNKNOWN with a score of 0, and so is everything where nothing was
    learned. Of equally likely languages the first by name is given. Rows with null or repeated ids are
    predicted like others; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(batch: pa.RecordBatch):
        for start in range(0, batch.num_rows, 64):
            part = batch.slice(start, 64)
            languages, scores = sent.value.predict(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs, of, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Null texts and texts without a letter are `und` with a score of 0. An empty table gives no rows;
    without a labelled document everything is `und`. Rows with null or repeated ids are predicted too.
    """
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
