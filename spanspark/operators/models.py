"""Sequence models: logistic emissions, counted transitions, Viterbi decoding, ablation grids, tagger and parser plug-ins."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanspark.operators.bio import B, I, O

TAGS = (O, B, I)
START = "<s>"
PAD, MAX_SUBWORDS = 0, 128


def transitions(tags: DataFrame) -> DataFrame:
    """(before, tag, n): counted tag pairs; a sentence's first tag follows <s>."""
    before = F.coalesce(F.lag("tag").over(Window.partitionBy("sid").orderBy("i")), F.lit(START))
    return tags.select(before.alias("before"), "tag").groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"))


def attribute_weights(tags: DataFrame, attribute: Column) -> DataFrame:
    """(attr, tag, weight): smoothed log-odds of B and I tags given an attribute."""
    n = tags.select(attribute.alias("attr"), "tag").groupBy("attr").agg(*(F.count_if(F.col("tag") == t).alias(t) for t in TAGS), F.count(F.lit(1)).alias("all"))
    each = n.select("attr", "all", F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(f"`{t}`").alias("n")) for t in (B, I)))).alias("x"))
    return each.select("attr", "x.tag", F.round(F.log((F.col("x.n") + 1) / (F.col("all") - F.col("x.n") + 1)), 6).alias("weight"))


def log_transitions(counts: Iterable, smooth: float = 1.0) -> np.ndarray:
    """(1 + tags) x tags log probabilities from (before, tag, n) rows; I never follows O or <s>."""
    m = np.full((len(TAGS) + 1, len(TAGS)), smooth)
    rows = {t: k for k, t in enumerate((*TAGS, START))}
    for before, tag, n in counts:
        m[rows[before], rows[tag]] += n
    m = np.log(m / m.sum(axis=1, keepdims=True))
    m[[0, len(TAGS)], 2] = -math.inf
    return m


def viterbi(emissions: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best path of tags; of equals the first tag."""
    best, back = emissions[0] + moves[-1], []
    for row in emissions[1:]:
        paths = best[:, None] + moves[:-1]
        back.append(paths.argmax(axis=0))
        best = paths.max(axis=0) + row
    path = [int(best.argmax())]
    for pointers in reversed(back):
        path.append(int(pointers[path[-1]]))
    return path[::-1]


def decode(scored: DataFrame, moves: np.ndarray) -> DataFrame:
    """(sid, i, tag) from scored(sid, i, scores): log scores of the tags for each token. Sentences stream by as arrays."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, places, tags = [], [], []
            for sid, rows in zip(batch.column("sid").to_pylist(), batch.column("rows").to_pylist(), strict=True):
                path = viterbi(np.array([r["scores"] for r in rows]), moves)
                sids += [sid] * len(rows)
                places += [r["i"] for r in rows]
                tags += [TAGS[k] for k in path]
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(places, pa.int32()), pa.array(tags, pa.string())], ["sid", "i", "tag"])

    whole = scored.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "scores"))).alias("rows"))
    return whole.mapInArrow(each, "sid bigint, i int, tag string")


def majority_tags(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(sid, i, tag) of test(sid, i, columns): the tag that train(tag, columns) most often gives these values, of equals the first by name; unseen: O."""
    n = train.groupBy(*columns, "tag").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*columns).agg(F.min_by("tag", F.struct(-F.col("n"), F.col("tag"))).alias("best"))
    return test.select("sid", "i", *columns).join(best, list(columns), "left").select("sid", "i", F.coalesce("best", F.lit(O)).alias("tag"))


def fit_emissions(features: DataFrame, columns: Sequence[str], buckets: int = 1 << 12, steps: int = 50):
    """A pipeline of hashed attr=value features and multinomial logistic regression over tags."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import FeatureHasher

    hasher = FeatureHasher(inputCols=list(columns), outputCol="hashed", numFeatures=buckets, categoricalCols=list(columns))
    model = LogisticRegression(featuresCol="hashed", labelCol="label", maxIter=steps, regParam=0.001, elasticNetParam=0.1, family="multinomial")
    return Pipeline(stages=[hasher, model]).fit(features)


def emission_scores(model, features: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(features).select("sid", "i", F.transform(vector_to_array("probability"), lambda p: F.log(F.greatest(p, F.lit(1e-9)))).alias("scores"))


def run_grid(configs: dict[str, Sequence[str]], evaluate: Callable[[str, Sequence[str]], dict]) -> list[dict]:
    """One metrics record per configuration; configurations are few, their work is distributed."""
    return [{"config": name, **evaluate(name, columns)} for name, columns in configs.items()]


def curriculum(tags: DataFrame, stages: Sequence[tuple[str, Sequence[str], int]]) -> DataFrame:
    """(ord, stage, init, epochs, sentences): a training plan of stages (name, splits, epochs), each of which starts from the one before."""
    spark = tags.sparkSession
    plan = spark.createDataFrame([(k, name, stages[k - 1][0] if k else None, epochs, list(splits)) for k, (name, splits, epochs) in enumerate(stages)], "ord bigint, stage string, init string, epochs bigint, splits array<string>")
    n = tags.groupBy("split").agg(F.countDistinct("sid").alias("n"))
    each = plan.withColumn("split", F.explode("splits")).join(n, "split", "left")
    return each.groupBy("ord", "stage", "init", "epochs").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sentences"))


def best_config(metrics: DataFrame) -> DataFrame:
    """(config, value) with the largest value; of equals the first by ord."""
    return metrics.groupBy().agg(F.max_by("config", F.struct("value", -F.col("ord"))).alias("config"), F.max("value").alias("value"))


def early_stop(log: DataFrame, patience: int) -> DataFrame:
    """(run, best_epoch, stop_epoch) of evaluation logs (run, epoch, value): stops after patience evaluations without a gain."""
    order = Window.partitionBy("run").orderBy("epoch")
    x = log.withColumn("before", F.max("value").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("gain", F.coalesce(F.col("value") > F.col("before"), F.lit(True)))
    x = x.withColumn("best", F.last(F.when(F.col("gain"), F.col("epoch")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("stop", F.col("epoch") - F.col("best") >= patience)
    stop = F.coalesce(F.min(F.when(F.col("stop"), F.col("epoch"))), F.max("epoch"))
    stops = x.groupBy("run").agg(stop.alias("stop_epoch"))
    seen = x.join(stops, "run").where("epoch <= stop_epoch")
    return seen.groupBy("run").agg(F.max("best").alias("best_epoch"), F.max("stop_epoch").alias("stop_epoch"))


def tag_words(sentences: DataFrame, tagger: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(sid, i, tok, postag) of sentences(sid, toks); without a tagger, or where its tags don't fit, UNK."""
    unknown = F.array_repeat(F.lit("UNK"), F.size("toks"))
    if tagger is None:
        tagged = sentences.select("sid", "toks", unknown.alias("tags"))
    else:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(tags=[list(tagger(list(t))) for t in b.toks])[["sid", "toks", "tags"]]

        tagged = sentences.select("sid", "toks").mapInPandas(each, "sid bigint, toks array<string>, tags array<string>")
        tagged = tagged.withColumn("tags", F.when(F.size("tags") == F.size("toks"), F.col("tags")).otherwise(unknown))
    return tagged.select("sid", F.posexplode(F.arrays_zip("toks", "tags")).alias("i", "x")).select("sid", "i", F.col("x.toks").alias("tok"), F.col("x.tags").alias("postag"))


def first_subwords(subwords: DataFrame) -> DataFrame:
    """(sid, j, label): only a word's first subword keeps its label, the others are null (ignored)."""
    order = Window.partitionBy("sid").orderBy("j")
    return subwords.withColumn("label", F.when(F.coalesce(F.lag("i").over(order) != F.col("i"), F.lit(True)), F.col("label"))).select("sid", "j", "i", "label")


def subword_labels(words: DataFrame, n: Column) -> DataFrame:
    """(sid, j, i, label) of words(sid, i, label) cut into n subwords each: j runs through the sentence, and only a word's first keeps its label.

    Words are numbered before they are cut, so no window holds or sorts subwords. Words of one place (of sentences with one id)
    take turns, subword by subword, as an order by (i, part) has it.
    """
    order = Window.partitionBy("sid").orderBy("i")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = words.select("sid", "i", "label", n.cast("bigint").alias("n")).where("n > 0").withColumn("before", before)
    x = x.withColumn("others", F.row_number().over(order) - F.rank().over(order)).withColumn("same", F.collect_list("n").over(order.rangeBetween(Window.currentRow, Window.currentRow)))
    each = x.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    first = F.col("before") - F.aggregate(F.slice("same", 1, F.col("others")), F.lit(0).cast("bigint"), lambda a, m: a + m)
    turns = F.aggregate("same", F.lit(0).cast("bigint"), lambda a, m: a + F.least(m, F.col("part"))) + F.size(F.filter(F.slice("same", 1, F.col("others")), lambda m: m > F.col("part")))
    j = F.when(F.size("same") == 1, F.col("before") + F.col("part")).otherwise(first + turns)
    return each.select("sid", j.alias("j"), "i", F.when(F.col("part") == 0, F.col("label")).alias("label"))


def padded(sentences: DataFrame, column: str, batch: Column, pad: int = PAD) -> DataFrame:
    """Arrays filled up to the longest of their batch."""
    whole = Window.partitionBy("batch")
    x = sentences.withColumn("batch", batch).withColumn("longest", F.max(F.size(column)).over(whole))
    return x.withColumn(column, F.concat(column, F.array_repeat(F.lit(pad), F.col("longest") - F.size(column)))).drop("longest")


def random_tags(tokens: DataFrame, seed: str = "42") -> DataFrame:
    """A repeatable noise predictor: 10 % B; 10 % I where the token before isn't O."""
    draw = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.col("sid").cast("string"), F.col("i").cast("string"), F.lit(seed))), 1, 8), 16, 10).cast("bigint"), F.lit(10))
    x = tokens.withColumn("draw", draw)
    order = Window.partitionBy("sid").orderBy("i")
    opener = F.max(F.when(F.col("draw") != 1, F.struct("i", F.col("draw").alias("d")))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    tag = F.when(F.col("draw") == 0, B).when((F.col("draw") == 1) & F.coalesce(opener["d"] == 0, F.lit(False)), I).otherwise(O)
    return x.withColumn("tag", tag).drop("draw")
