"""Quality classifier: histogram gradient-boosted trees over document statistics.

Trees are learnt on the driver from a bounded sample of labelled rows (``train_rows``, the smallest hashes of their
ids), whose statistics are computed where the texts are; every text is then scored with all trees at once: complete
binary trees, flattened into arrays and walked level by level with numpy.

Defined results: null text is the empty text and is scored like any other; a null doc_id is not held out and never
labelled; where an id's labels disagree the smaller counts; of equal splits the first feature and threshold count, and a
value equal to a threshold goes left; very long texts are measured whole; repeated rows give one row each; without usable
labels every score is 0.5; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import BLANKS, bound_batches, text_of

TRAIN_ROWS, TREES, DEPTH, BINS, RATE, L2, MIN_HESSIAN = 20_000, 60, 4, 64, 0.2, 1.0, 2.0
THRESHOLD, FOLDS, HELD_OUT_FOLD = 0.7, 4, 2
SYMBOLS = b"#*$%&|<>"
BYTE_GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "above_ascii": range(128, 256), "symbol": SYMBOLS, "pipe": b"|", "exclaim": b"!", "stop": b".", "comma": b",",
    "other_mark": bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS + b"!.,"), "blank": BLANKS.encode(),
}
STATISTICS = ("log_chars", "log_words", "word_length", "distinct_words", "commonest_word", "one_char_words", "marked_words", "line_words", "distinct_lines", "longest_line", *BYTE_GROUPS)
GROUPS = np.zeros((len(BYTE_GROUPS), 256))
for _row, _bytes in enumerate(BYTE_GROUPS.values()):
    GROUPS[_row, list(_bytes)] = 1
ENDS = tuple("abcdefghijklmnopqrstuvwxyz.,")


def statistics(text: str) -> list[float]:
    """What is known of a text; all zeros for the empty text."""
    raw = text.encode()
    words = text.split()
    n = len(words)
    if not n:
        return [math.log1p(len(raw))] + [0.0] * (len(STATISTICS) - 1)
    lines = [x for x in text.split("\n") if x]
    groups = GROUPS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    marked = sum(c for w, c in counts.items() if w[-1] < "\x80" and not w.lower().endswith(ENDS))
    own = [math.log1p(len(raw)), math.log1p(n), lengths.mean(), len(counts) / n, max(counts.values()) / n, float((lengths == 1).mean()), marked / n, math.log1p(n / max(1, len(lines))), len(set(lines)) / max(1, len(lines)), math.log1p(max(map(len, lines), default=0))]
    return own + groups.tolist()


@dataclass
class Trees:
    """Split feature and threshold of each inner node, value of each leaf, by tree; leaf values are summed to a logit."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros((len(x), len(self.feature)), np.int64)
        trees, rows = np.arange(len(self.feature)), np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(math.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        return 1 / (1 + np.exp(-(self.bias + self.leaf[trees, at - inner].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """Logistic boosting; each level of a tree takes the best split of every node from histograms of gradients."""
    inner, width = 2**depth - 1, x.shape[1] if x.ndim == 2 else len(STATISTICS)
    model = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), 0.0)
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else math.copysign(3.0, y[0] - 0.5)
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    logit = np.full(len(y), model.bias)
    cell = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            n = 2**level
            where = (node[:, None] * (width * bins) + cell).ravel()
            gh = [np.bincount(where, np.repeat(v, width), n * width * bins).reshape(n, width, bins).cumsum(axis=2) for v in (g, h)]
            left, total = gh, [v[:, :, -1:] for v in gh]
            right = [a - b for a, b in zip(total, left, strict=True)]
            gain = left[0] ** 2 / (left[1] + L2) + right[0] ** 2 / (right[1] + L2) - total[0] ** 2 / (total[1] + L2)
            gain = np.where((left[1] >= MIN_HESSIAN) & (right[1] >= MIN_HESSIAN), gain, -np.inf).reshape(n, -1)
            best = gain.argmax(axis=1)
            split_feature, split_bin = np.full(n, 0), np.full(n, bins)
            for k in np.flatnonzero(gain[np.arange(n), best] > 1e-9):
                f, b = divmod(int(best[k]), bins)
                if b < len(cuts[f]):
                    split_feature[k], split_bin[k] = f, b
                    model.feature[t, n - 1 + k], model.threshold[t, n - 1 + k] = f, cuts[f][b]
            node = 2 * node + (binned[np.arange(len(y)), split_feature[node]] > split_bin[node])
        sums = [np.bincount(node, v, inner + 1) for v in (g, h)]
        model.leaf[t] = -rate * sums[0] / (sums[1] + L2)
        logit += model.leaf[t][node]
    return model


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most train_rows labelled rows outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold() != HELD_OUT_FOLD))
    chosen = usable.groupBy("doc_id").agg(F.min("quality").cast("double").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select("doc_id", text_of().alias("whole")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "whole")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    found = texts.mapInArrow(rows, "doc_id bigint, quality double, x array<double>").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(train_rows).collect()
    return np.array([r.x for r in found]).reshape(-1, len(STATISTICS)), np.array([r.quality > 0 for r in found], float)


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text); labels(doc_id, quality) only teach."""
    docs = bound_batches(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = fit(*training_rows(docs, labels.withColumn("doc_id", F.col("doc_id").cast("bigint")), train_rows))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(STATISTICS))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select("doc_id", F.coalesce(fold() == HELD_OUT_FOLD, F.lit(False)).alias("held_out"), text_of().alias("whole"))
    return own.mapInArrow(scored, "doc_id bigint, held_out boolean, score double, predicted int")
