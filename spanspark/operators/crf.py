"""A linear-chain conditional random field over hashed attributes, trained on all sentences where they are.

Every evaluation of the objective is one job: a task runs forward and backward over its sentences, step by step for many
sentences at once, and sends one row with its loss and gradient; rows meet in a few tasks before the driver adds them.
The driver holds the parameters only (a weight per attribute bucket and tag, and the moves between tags) and minimises
the negative log-likelihood with an L1 and an L2 penalty by limited-memory quasi-Newton steps inside orthants.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.operators.bio import encode
from spanspark.operators.models import TAGS
from spanspark.storage import bound_batches, checkpointed

#: Places of sentences (longest times number) that a task works on at once, and tasks in which gradients meet.
CHUNK_PLACES, MEETING_TASKS = 200_000, 8


@dataclass
class Crf:
    """weights: (buckets, tags); moves: (tags + 1, tags), the last row for a sentence's first tag."""

    columns: tuple[str, ...]
    weights: np.ndarray
    moves: np.ndarray


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def loss_and_gradient(weights: np.ndarray, moves: np.ndarray, attributes: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood of sentences and its gradients; attributes: (tokens, columns), sentences one after the other."""
    n, longest = len(lengths), int(lengths.max())
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")  # so that the sentences that reach a step are the first ones
    size = lengths[order]
    reach = [int(np.searchsorted(-size, -t, side="left")) for t in range(longest)]
    place = starts[order][None, :] + np.arange(longest)[:, None]
    change, first = moves[:-1], moves[-1]
    own = weights[attributes].sum(axis=1)
    ahead, back = np.zeros((longest, n, len(TAGS))), np.zeros((longest, n, len(TAGS)))
    ahead[0] = first + own[place[0]]
    for t in range(1, longest):
        m = reach[t]
        ahead[t, :m] = log_sum(ahead[t - 1, :m, :, None] + change, 1) + own[place[t, :m]]
    for t in range(longest - 2, -1, -1):
        m = reach[t + 1]
        back[t, :m] = log_sum(change + (own[place[t + 1, :m]] + back[t + 1, :m])[:, None, :], 2)
    whole = log_sum(ahead[size - 1, np.arange(n)], 1)
    seen, moved = np.empty_like(own), np.zeros_like(moves)
    for t in range(longest):
        m = reach[t]
        seen[place[t, :m]] = np.exp(ahead[t, :m] + back[t, :m] - whole[:m, None])
        if t:
            moved[:-1] += np.exp(ahead[t - 1, :m, :, None] + change + (own[place[t, :m]] + back[t, :m])[:, None, :] - whole[:m, None, None]).sum(axis=0)
    moved[-1] = seen[starts].sum(axis=0)
    inner = np.ones(len(tags), bool)
    inner[starts] = False
    before, after = tags[:-1][inner[1:]], tags[1:][inner[1:]]
    score = own[np.arange(len(tags)), tags].sum() + first[tags[starts]].sum() + change[before, after].sum()
    seen[np.arange(len(tags)), tags] -= 1
    np.add.at(moved, (before, after), -1)
    np.add.at(moved[-1], tags[starts], -1)
    flat = attributes.ravel()
    by_tag = [np.bincount(flat, np.repeat(seen[:, k], attributes.shape[1]), len(weights)) for k in range(len(TAGS))]
    return float(whole.sum() - score), np.stack(by_tag, axis=1), moved


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, l1: float, iterations: int, memory: int = 6, tolerance: float = 1e-4) -> np.ndarray:
    """x that minimises f(x) + l1 |x|, f giving its value and gradient; a step never leaves the orthant it starts in."""
    value, slope = f(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        steepest = np.where(x != 0, slope + l1 * np.sign(x), np.sign(slope) * np.maximum(np.abs(slope) - l1, 0))
        if not np.abs(steepest).max() > 1e-9:
            break
        way, scales = steepest.copy(), []
        for s, y in reversed(steps):
            scales.append(s @ way / (s @ y))
            way -= scales[-1] * y
        if steps:
            way *= steps[-1][0] @ steps[-1][1] / (steps[-1][1] @ steps[-1][1])
        for (s, y), scale in zip(steps, reversed(scales), strict=True):
            way += (scale - y @ way / (s @ y)) * s
        way = np.where(way * steepest > 0, -way, 0.0)
        orthant = np.where(x != 0, np.sign(x), -np.sign(steepest))
        goal, step = value + l1 * np.abs(x).sum(), 1.0 if steps else 1 / np.linalg.norm(steepest)
        for _ in range(30):
            new = x + step * way
            new[new * orthant < 0] = 0.0
            new_value, new_slope = f(new)
            reached = new_value + l1 * np.abs(new).sum()
            if reached <= goal + 1e-4 * (steepest @ (new - x)):
                break
            step /= 2
        else:
            break
        if (new - x) @ (new_slope - slope) > 1e-10:
            steps = [*steps, (new - x, new_slope - slope)][-memory:]
        x, value, slope = new, new_value, new_slope
        if goal - reached < tolerance * max(1.0, abs(reached)):
            break
    return x


def sentences(features: DataFrame, columns: Sequence[str], buckets: int, tag: str | None) -> DataFrame:
    """(sid, i, a, t): a sentence's places, its tokens' attribute buckets one after the other, and its tag codes."""
    hashed = F.array(*(F.pmod(F.xxhash64(F.lit(c), F.col(c).cast("string")), F.lit(buckets)).cast("int") for c in columns))
    code = encode(F.col(tag)) if tag else F.lit(0)
    rows = features.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", hashed.alias("a"), code.cast("int").alias("t")))).alias("rows"))
    return rows.select("sid", "rows.i", F.flatten("rows.a").alias("a"), "rows.t")


def flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Attributes, tags and lengths of some sentences at a time."""
    for batch in batches:
        lengths = batch.column("t").value_lengths().to_numpy()
        tags = flat(batch, "t")
        attributes = flat(batch, "a").reshape(len(tags), -1)
        ends = np.cumsum(lengths)
        first = longest = 0
        for k, n in enumerate([*lengths.tolist(), None]):
            if k > first and (n is None or max(longest, n) * (k - first + 1) > CHUNK_PLACES):
                at = slice(ends[first] - lengths[first], ends[k - 1])
                yield attributes[at], tags[at], lengths[first:k]
                first, longest = k, 0
            longest = max(longest, n or 0)


def fit(features: DataFrame, columns: Sequence[str], tag: str = "tag", buckets: int = 1 << 14, l1: float = 0.1, l2: float = 0.1, iterations: int = 50) -> Crf:
    """The field that fits features(sid, i, columns…, tag)."""
    spark = features.sparkSession
    rows = checkpointed(sentences(features, columns, buckets, tag))
    shape, moves_shape = (buckets, len(TAGS)), (len(TAGS) + 1, len(TAGS))

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[: buckets * len(TAGS)].reshape(shape), x[buckets * len(TAGS) :].reshape(moves_shape)

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(x)

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, moves = parts(sent.value)
            loss, slope = 0.0, np.zeros(len(sent.value))
            for attributes, tags, lengths in chunks(batches):
                part, by_weight, by_move = loss_and_gradient(weights, moves, attributes, tags, lengths)
                loss += part
                slope += np.concatenate([by_weight.ravel(), by_move.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], ["loss", "slope"])

        def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(len(sent.value))
            for batch in batches:
                loss += sum(batch.column("loss").to_pylist())
                for one in batch.column("slope"):
                    slope += np.frombuffer(one.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], ["loss", "slope"])

        schema = "loss double, slope binary"
        sums = rows.mapInArrow(own, schema).repartition(MEETING_TASKS).mapInArrow(added, schema).collect()  # one row per meeting task
        sent.destroy()
        return sum(r.loss for r in sums) + l2 * float(x @ x), sum(np.frombuffer(r.slope) for r in sums) + 2 * l2 * x

    start = np.zeros(buckets * len(TAGS) + moves_shape[0] * moves_shape[1])
    weights, moves = parts(minimised(objective, start, l1, iterations))
    return Crf(tuple(columns), weights, moves)


def best_paths(own: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """viterbi() of sentences that lie one after the other in own (tokens, tags), step by step for all of them at once."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")  # so that the sentences that reach a step are the first ones
    begins, size = starts[order], lengths[order]
    reach = [int(np.searchsorted(-size, -t, side="left")) for t in range(int(size[0]))]
    best, back = own[begins[: reach[0]]] + moves[-1], []
    for t in range(1, len(reach)):
        m = reach[t]
        paths = best[:m, :, None] + moves[:-1]
        back.append(paths.argmax(axis=1))
        best[:m] = paths.max(axis=1) + own[begins[:m] + t]
    at, path = best.argmax(axis=1), np.empty(len(own), int)
    for t in range(len(reach) - 1, -1, -1):
        m = reach[t]
        path[begins[:m] + t] = at[:m]
        if t:
            at[:m] = back[t - 1][np.arange(m), at[:m]]
    return path


def decode(model: Crf, features: DataFrame) -> DataFrame:
    """(sid, i, tag): each sentence's best path."""
    sent = features.sparkSession.sparkContext.broadcast((model.weights, model.moves))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, moves = sent.value
        for batch in batches:
            lengths = batch.column("t").value_lengths().to_numpy()
            own = weights[flat(batch, "a").reshape(int(lengths.sum()), -1)].sum(axis=1)
            paths = best_paths(own, lengths, moves) if len(own) else []
            sids = np.repeat(batch.column("sid").to_numpy(), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(flat(batch, "i"), pa.int32()), pa.array([TAGS[k] for k in paths], pa.string())], ["sid", "i", "tag"])

    return bound_batches(sentences(features, model.columns, len(model.weights), None)).mapInArrow(each, "sid bigint, i int, tag string")
