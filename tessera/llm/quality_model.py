"""Quality classifier: a generalised additive model with pairwise interactions.

Numeric features of the whole text are cut into bins. Boosting goes round the features in a cycle;
each step fits a shallow tree on one feature's bins to the logistic gradient and adds it, shrunk, to the
feature's lookup table. Then pairs of features are ranked by what a coarse grid of both takes from the
remaining loss, and the best are boosted in the same cyclic way on their grids. A score is the sum of the
intercept and one table entry for each feature and pair: vectorised lookups, no trees. A step on a pair
fits a tree of depth two: one cut of one feature, and one cut of the other feature on either side of it.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed, held_out, map_arrow, read_table

#: Labelled rows that a model is fitted on at most: those whose hashed ids come first.
SAMPLE = 20_000
#: Bins of a feature, bins of a feature within a pair, pairs; rounds, shrinkage, leaves and least weight of a leaf.
BINS, PAIR_BINS, PAIRS = 64, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, LEAST = 150, 60, 0.1, 4, 20.0
#: A score of this or more predicts label 1.
PREDICT = 0.3

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper_share", "digit_share", "symbol_share", "punct_share", "space_share", "symbol_words",
    "distinct_words", "repeat_next", "top_word", "repeat_triples", "lines", "mean_line", "dup_lines", "stop_end", "upper_words", "short_words", "accent_share",
)
_SYMBOLS = frozenset(b"#*$%&|<>@^~=+{}[]\\/_")
_CLASS = np.zeros((5, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, list(_SYMBOLS)] = True
_CLASS[3, list(b".,;:!?'\"()-")] = True
_CLASS[4, [9, 10, 11, 12, 13, 32]] = True
_UPPER = re.compile(rb"[A-Z]{2,}")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; all 0 for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digit, symbol, punct, space = (float(counts[c].sum()) / size for c in _CLASS)
    lengths = [len(w) for w in words]
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], np.int64)
    of_word = np.bincount(ids)
    triples = ids[:-2] * 1_000_003 + ids[1:-1] * 1_009 + ids[2:] if n > 2 else ids[:0]
    repeated = 1 - len(np.unique(triples)) / len(triples) if len(triples) else 0.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(size), np.log1p(n), sum(lengths) / n, float(min(max(lengths), 1000)), upper, digit, symbol, punct, space, sum(1 for w in number if w[-1] in _SYMBOLS) / len(number),
        len(number) / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, float(of_word.max()) / n, repeated, np.log1p(len(lines)), n / len(lines), 1 - len(set(lines)) / len(lines), sum(1 for x in lines if x.rstrip()[-1:] in b".!?") / len(lines),
        sum(1 for w in number if _UPPER.match(w)) / len(number), sum(1 for x in lengths if x <= 3) / n, float(counts[128:].sum()) / size,
    ]


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, features array<double>) of every row of docs."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [features(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "features"])

    return map_arrow(docs, of, f"doc_id {dict(docs.dtypes)['doc_id']}, features array<double>")


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values by bin of a best-first tree of at most LEAVES leaves over ordered bins."""
    g, w = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def split(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        k = np.arange(a + 1, b)
        lg, lw, rg, rw = g[k] - g[a], w[k] - w[a], g[b] - g[k], w[b] - w[k]
        gain = np.where((lw >= LEAST / 4) & (rw >= LEAST / 4), lg**2 / (lw + 1) + rg**2 / (rw + 1), 0) - (g[b] - g[a]) ** 2 / (w[b] - w[a] + 1)
        best = int(gain.argmax())
        return float(gain[best]), int(k[best])

    leaves = [(split(0, len(gradient)), 0, len(gradient))]
    while len(leaves) < LEAVES:
        at = max(range(len(leaves)), key=lambda i: leaves[i][0][0])
        (gain, k), a, b = leaves[at]
        if gain <= 1e-9:
            break
        leaves[at : at + 1] = [(split(a, k), a, k), (split(k, b), k, b)]
    out = np.zeros(len(gradient))
    for _, a, b in leaves:
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values by cell of the best tree of depth two over a grid: a cut by rows and one by columns on either side, or the other way round."""

    def best(g: np.ndarray, w: np.ndarray) -> tuple[float, int, tuple[int, int]]:
        """Gain, row cut and column cuts above and below, rows cut first."""
        if min(g.shape) < 2:
            return 0.0, 0, (0, 0)
        # sums over the rows up to each cut, and over those beyond; then over the columns up to each cut
        top, top_w = np.cumsum(g, axis=0)[:-1], np.cumsum(w, axis=0)[:-1]
        gain, cuts = np.zeros(len(top)), []
        for half, half_w in ((top, top_w), (g.sum(axis=0) - top, w.sum(axis=0) - top_w)):
            left, left_w = np.cumsum(half, axis=1), np.cumsum(half_w, axis=1)
            all_g, all_w = left[:, -1:], left_w[:, -1:]
            left, left_w = left[:, :-1], left_w[:, :-1]
            enough = (left_w >= LEAST / 4) & (all_w - left_w >= LEAST / 4)
            of = np.where(enough, left**2 / (left_w + 1) + (all_g - left) ** 2 / (all_w - left_w + 1), 0)
            gain += of.max(axis=1)
            cuts.append(of.argmax(axis=1) + 1)
        k = int(gain.argmax())
        return float(gain[k]), k + 1, (int(cuts[0][k]), int(cuts[1][k]))

    by_rows, by_columns = best(gradient, weight), best(gradient.T, weight.T)
    turned = by_columns[0] > by_rows[0]
    gain, cut, inner = by_columns if turned else by_rows
    out = np.zeros(gradient.shape)
    if gain <= 1e-9:
        return out
    g, w, view = (gradient.T, weight.T, out.T) if turned else (gradient, weight, out)
    for rows, c in ((slice(0, cut), inner[0]), (slice(cut, None), inner[1])):
        for columns in (slice(0, c), slice(c, None)):
            view[rows, columns] = g[rows, columns].sum() / (w[rows, columns].sum() + 1)
    return out


class AdditiveModel:
    """Bins, lookup tables and intercept."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: rows of features, y: labels 0 and 1."""
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
        self.coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.empty(0) for j in range(k)]
        rate = (y.sum() + 1) / (n + 2)
        self.intercept = float(np.log(rate / (1 - rate)))
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if not 0 < y.sum() < n:
            return
        bins = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]
        score = np.full(n, self.intercept)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-score))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        for _ in range(ROUNDS):
            for j in range(k):
                g, h = slope()
                size = len(self.tables[j])
                step = RATE * _tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size))
                self.tables[j] += step
                score += step[bins[j]]
        small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.coarse)]
        g, h = slope()
        gains = []
        for a, b in combinations(range(k), 2):
            width = len(self.coarse[b]) + 1
            cell = small[a] * width + small[b]
            size = (len(self.coarse[a]) + 1) * width
            gains.append((float((np.bincount(cell, g, size) ** 2 / (np.bincount(cell, h, size) + 5)).sum()), a, b))
        self.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((len(self.coarse[a]) + 1, len(self.coarse[b]) + 1)) for a, b in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for q, (a, b) in enumerate(self.pairs):
                g, h = slope()
                shape = self.grids[q].shape
                cell = small[a] * shape[1] + small[b]
                gg, hh = (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))
                step = RATE * _pair_tree(gg, hh)
                self.grids[q] += step
                score += step[small[a], small[b]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1."""
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (a, b), grid in zip(self.pairs, self.grids):
            total += grid[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, least: float = PREDICT) -> DataFrame:
    """(doc_id, held_out boolean, score double, predicted int) for every row of docs.

    labels has doc_id and quality (0 or 1; other values and nulls are left out; of several for an id
    the smallest counts). The model is fitted on at most `sample` labelled ids that are not held out,
    the first by a hash of them, a row of features for each (of an id's several the smallest); features
    alone are its inputs. Features are computed once for all whole texts, however long, and kept in the
    shared folder. Null and empty texts have features of 0 and get a score like others. Without labels
    of both kinds every score is the share of label 1, smoothed. Rows with null or repeated ids are
    scored like others; other columns are not read, whatever their names. An empty table gives no rows.
    """
    known = checkpointed(text_features(docs, id_col, text_col))
    usable = labels.select(F.col("doc_id").alias("label_id"), "quality").where("quality in (0, 1) and label_id is not null").where(~held_out(F.col("label_id"))).groupBy("label_id").agg(F.min("quality").alias("quality"))
    chosen = F.broadcast(usable.orderBy(F.xxhash64("label_id"), "label_id").limit(sample))
    rows = known.join(chosen, known["doc_id"] == chosen["label_id"]).groupBy("label_id", "quality").agg(F.min("features").alias("features")).collect()
    rows.sort(key=lambda r: r.label_id)
    x = np.array([r.features for r in rows], float).reshape(-1, len(FEATURES))
    model = AdditiveModel(x, np.array([r.quality for r in rows], float))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = model.scores(np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], names=["doc_id", "score"])

    scored = map_arrow(known, of, f"doc_id {dict(known.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
