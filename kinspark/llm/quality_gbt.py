"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are trained on the driver from a bounded sample of labelled rows and flattened into arrays, which
workers traverse for whole batches of documents at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, prepare

#: At most so many labelled documents are learnt from: those with the smallest hash of their id.
TRAINING_ROWS = 20_000
#: A document is predicted to be good from this score on.
THRESHOLD = 0.3
FOLDS = 5

FEATURES = (
    "log_words", "mean_word", "spread_word", "symbols", "pipes", "symbol_ends", "repeats_before", "distinct_words",
    "top_word", "longest_run", "repeated_lines", "lines", "digits", "capitals", "stops", "not_ascii", "single_letters",
)
_CLASSES = {name: np.frombuffer(chars, np.uint8) for name, chars in {
    "symbols": b"#*$%&|<>", "pipes": b"|", "digits": b"0123456789", "capitals": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "stops": b".,;:!?",
}.items()}
_ENDS = frozenset(b"#*$%&|<>")


def statistics(text: str) -> list[float]:
    """FEATURES of a whole text; all 0 where it has no words."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = {name: float(counts[chars].sum()) / len(data) for name, chars in _CLASSES.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    same = np.fromiter(map(eq, words[1:], words), bool, n - 1)
    breaks = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    tally = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()), share["symbols"], share["pipes"],
        sum(w[-1] in _ENDS for w in words) / n, float(same.sum()) / n, len(tally) / n, max(tally.values()) / n,
        float(np.diff(breaks).max()) / n, 1 - len(set(lines)) / len(lines), len(lines) / n, share["digits"], share["capitals"],
        share["stops"], float(counts[128:].sum()) / len(data), float((lengths == 1).sum()) / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth; node i has the children 2i + 1 and 2i + 2. A node that isn't split sends all rows left."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def margins(self, x: np.ndarray) -> np.ndarray:
        rows, first = np.arange(len(x)), (1 << self.depth) - 1
        total = np.full(len(x), self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - first]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """Boosted trees for log loss; splits are searched in histograms of at most `bins` bins a feature."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    positive = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(positive / (1 - positive))), depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if len(y) < 2 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for column in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)])
    n_features, margin = len(edges), np.full(len(y), model.base)
    built: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = (node - first) * bins
            g, h, c = (np.empty((n_features, wide, bins)) for _ in range(3))
            for f in range(n_features):
                for into, weights in ((g, gradient), (h, weight), (c, None)):
                    into[f] = np.bincount(at + binned[f], weights, wide * bins).reshape(wide, bins)
            gl, hl, cl = (np.cumsum(a, axis=2) for a in (g, h, c))
            gt, ht, ct = (a[:, :, -1:] for a in (gl, hl, cl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(cl < least) | (ct - cl < least)] = 0
            flat = gain.transpose(1, 0, 2).reshape(wide, -1)
            best = flat.argmax(axis=1)
            cut = np.full(wide, bins)
            for k in np.flatnonzero(flat[np.arange(wide), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                if b < len(edges[f]):
                    feature[first + k], threshold[first + k], cut[k] = f, edges[f][b], b
            own = node - first
            node = 2 * node + 1 + (binned[feature[node], np.arange(len(y))] > cut[own])
        leaf = node - inner
        value = rate * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, weight, leaves) + ridge)
        margin += value[leaf]
        built.append((feature, threshold, value))
    model.feature, model.threshold, model.value = (np.stack(a) for a in zip(*built))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fold that nothing is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `rows` labelled documents outside the held-out fold."""
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"))
    usable = usable.filter(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
    chosen = usable.groupBy("_id").agg(F.max("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(as_text(t.as_py())) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(stats, pa.list_(pa.float64()))], ["id", "label", "x"])

    # At most TRAINING_ROWS rows of a few numbers reach the driver; a repeated id counts once, before that.
    each = texts.select("_id", "_label", "_text").mapInArrow(measure, "id long, label int, x array<double>")
    found = each.groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.label", "r.x").toArrow()
    order = np.argsort(found.column("id").to_numpy(), kind="stable")
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return x[order], found.column("label").to_numpy()[order].astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    prepare(docs.sparkSession)
    return train(*training_sample(docs, labels, id_col, text_col, label_col, rows))


def score(docs: DataFrame, model: Trees, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column, the score of each row's whole text (0 to 1); the other columns pass as they are.

    A null or empty text has statistics of 0 and is scored like any other. Repeated rows get equal scores; an empty table
    stays empty. `into` must not be a column of docs.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(as_text(t.as_py())) for t in batch.column(at)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(x))], [*batch.schema.names, into])

    return docs.mapInArrow(traverse, T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Learns from `labels` outside the held-out fold (crc32 of the id as text, modulo 5, is 0). Without labels of both kinds every
    score is the share of good ones (0.5 with none). Null ids are scored, never learnt from; other columns aren't read.
    """
    model = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
