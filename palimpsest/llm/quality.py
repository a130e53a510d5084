"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting: in each round every feature in turn gets a shallow tree over its bins,
fitted to the gradient of the log loss, and the tree's leaves are added to the feature's
lookup table at a low rate. The pairs of features that explain most of what is left get
two-dimensional tables in the same way. A score is the sum of table entries, looked up for
all rows at once. Inputs are measures of the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import bucket_of, documents

#: Fitting reads at most this many labelled rows, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
BINS = 32
COARSE = 8
ROUNDS = 200
PAIR_ROUNDS = 60
PAIRS = 6
RATE = 0.1
THRESHOLD = 0.3

CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t", "line": b"\n", "stop": b".?", "bang": b"!", "comma": b",;:",
    "bar": b"|<>{}[]\\/=_", "mark": b"*#$%&@^~+", "wide": bytes(range(0x80, 0xC0)), "high": bytes(range(0xC0, 0x100)),
}
WEIGHTS = np.array([[float(b in members) for members in CLASSES.values()] for b in range(256)])
FEATURES = ("bytes", "words", "word_bytes", "distinct_words", "same_as_before", "distinct_lines", "line_words", *CLASSES, "bangs_a_word", "marks_a_word", "bars_a_word")


def measure(texts: pd.Series) -> np.ndarray:
    """Rows of FEATURES. Null texts are empty; of an empty text all measures are 0."""
    counts, rows = np.zeros((len(texts), 256)), []
    for i, text in enumerate(texts):
        text = text or ""
        counts[i] = np.bincount(np.frombuffer(text.encode(errors="replace"), np.uint8), minlength=256)
        words, lines = text.split(), text.split("\n")
        n = max(len(words), 1)
        rows.append((len(words), len(set(words)) / n, sum(map(eq, words, words[1:])) / n, len(set(lines)) / len(lines), len(words) / len(lines)))
    table = np.array(rows, float).reshape(-1, 5)
    size = counts.sum(axis=1)
    n, kinds = np.maximum(table[:, 0], 1), counts @ WEIGHTS
    named = dict(zip(CLASSES, kinds.T, strict=True))
    share = kinds / np.maximum(size, 1)[:, None]
    a_word = [named[k] / n for k in ("bang", "mark", "bar")]
    return np.column_stack([np.log1p(size), np.log1p(table[:, 0]), size / n, *table[:, 1:].T, *share.T, *a_word])


@dataclass
class Model:
    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # by feature: upper ends of its bins but the last
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for i, table in enumerate(self.tables):
                total += table[b[:, i]]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values by bin of a tree with this many leaves, grown best split first."""
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for a, b in parts:
            if b - a > 1:
                cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
                gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - _gain(cg[-1], ch[-1])
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a two-dimensional table into four."""
    sums = []
    for m in (g, h):
        c = m.cumsum(0).cumsum(1)
        q = c[:-1, :-1]
        sums.append((q, c[:-1, -1:] - q, c[-1:, :-1] - q, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + q))
    gains = sum(_gain(a, b) for a, b in zip(*sums, strict=True))
    if not gains.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    out = np.zeros_like(g)
    for rows, cols, k in ((slice(0, i + 1), slice(0, j + 1), 0), (slice(0, i + 1), slice(j + 1, None), 1), (slice(i + 1, None), slice(0, j + 1), 2), (slice(i + 1, None), slice(j + 1, None), 3)):
        out[rows, cols] = _leaf(sums[0][k][i, j], sums[1][k][i, j])
    return float(gains[i, j] - _gain(g.sum(), h.sum())), out


def boost(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit to rows of features and 0/1 labels. Without labels: 0.5 for all; of one kind: near it for all."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    for column in x.T:
        model.edges.append(np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="inverted_cdf")))
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(n) for n in sizes]
    total = np.full(len(y), model.intercept)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i, n in enumerate(sizes):
            g, h = gradient()
            step = RATE * _tree(np.bincount(b[:, i], g, n), np.bincount(b[:, i], h, n))
            model.tables[i] += step
            total += step[b[:, i]]
    g, h = gradient()
    ranked = []
    for i, j in combinations(range(len(sizes)), 2):
        coarse = b[:, i] * COARSE // sizes[i] * COARSE + b[:, j] * COARSE // sizes[j]
        grids = [np.bincount(coarse, v, COARSE * COARSE).reshape(COARSE, COARSE) for v in (g, h)]
        ranked.append((_quadrants(*grids)[0], i, j))
    model.pairs = [(i, j) for gain, i, j in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = gradient()
            cell = b[:, i] * sizes[j] + b[:, j]
            _, step = _quadrants(*(np.bincount(cell, v, table.size).reshape(table.shape) for v in (g, h)))
            table += RATE * step
            total += RATE * step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside the fold; null labels and ids without a document are left out.

    Of labels with one id the least counts; of documents with one id the one with the least measures.
    """
    rows = labels.filter("quality is not null and doc_id is not null").filter(bucket_of(F.col("doc_id"), 5) != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.min("quality").cast("double").alias("quality"))
    sample = rows.orderBy(F.xxhash64("labelled"), "labelled").limit(SAMPLE_ROWS)

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"labelled": part["labelled"], "quality": part["quality"], "x": list(measure(part["text"]))})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = texts.join(F.broadcast(sample), F.col("doc_id") == F.col("labelled")).select("labelled", "quality", "text").mapInPandas(features, "labelled long, quality double, x array<double>")
    found = measured.groupBy("labelled", "quality").agg(F.min("x").alias("x")).select("quality", "x").collect()  # SAMPLE_ROWS at most
    found.sort()  # the order of rows is not that of the tasks
    return boost(np.array([r.x for r in found]).reshape(-1, len(FEATURES)), np.array([r.quality for r in found]))


def scored(model: Model):
    """The model as a function of a text column."""

    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(model.score(measure(texts)), dtype=float)

    return F.pandas_udf(of, "double")


def op10_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts get the score of a text without words; repeated rows are scored alike, an empty table gives no rows."""
    docs = documents(spark, sf_dir)
    of = scored(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), of("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted bad go; columns stay as they are, whatever their names.

    Null texts count as empty. Without labels every score is 0.5, and all documents stay.
    """
    of = scored(fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(of("text") >= THRESHOLD)
