"""Comparison of gold and predicted tags: joins by sentence and position, span, token and sentence scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanspark.functions.text import f1
from spanspark.operators.bio import B, I, O, spans


def common_ids(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.select("sid").intersect(pred.select("sid"))


def missing_ids(gold: DataFrame, pred: DataFrame) -> DataFrame:
    return gold.select("sid").distinct().join(pred.select("sid"), "sid", "left_anti")


def token_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(sid, i, gold, pred) where both have a token; the longer sentence's rest falls away."""
    return gold.select("sid", "i", F.col("tag").alias("gold")).join(pred.select("sid", "i", F.col("tag").alias("pred")), ["sid", "i"])


def span_pairs(gold: DataFrame, pred: DataFrame, pooled: bool = False) -> DataFrame:
    """Distinct spans of both with in_gold and in_pred; pooled drops the sentence from the key, as pooled offsets do."""
    key = ["s", "e"] if pooled else ["sid", "s", "e"]
    mark = lambda df, name: df.select(*key).distinct().withColumn(name, F.lit(True))
    both = mark(gold, "in_gold").join(mark(pred, "in_pred"), key, "full")
    return both.select(*key, F.coalesce("in_gold", F.lit(False)).alias("in_gold"), F.coalesce("in_pred", F.lit(False)).alias("in_pred"))


def counted(tp, fp, fn) -> list:
    n = [x.cast("bigint").alias(k) for x, k in ((tp, "tp"), (fp, "fp"), (fn, "fn"))]
    return n + [F.round(v, 6).alias(k) for k, v in f1(tp, fp, fn).items()]


def span_scores(gold: DataFrame, pred: DataFrame, pooled: bool = False, lenient: bool = False) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 over the sentences that both hold."""
    ids = common_ids(gold, pred)
    g, p = (spans(x.join(ids, "sid", "left_semi"), lenient) for x in (gold, pred))
    pairs = span_pairs(g, p, pooled)
    n = pairs.agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"), F.count_if(~F.col("in_gold")).alias("fp"), F.count_if(~F.col("in_pred")).alias("fn"))
    return n.select(*counted(F.col("tp"), F.col("fp"), F.col("fn")))


def token_scores(gold: DataFrame, pred: DataFrame) -> DataFrame:
    g, p = F.col("gold") != O, F.col("pred") != O
    n = token_pairs(gold, pred).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g & ~p).alias("tn"))
    return n.select(*counted(F.col("tp"), F.col("fp"), F.col("fn")), F.col("tn").cast("bigint").alias("tn"))


def exact_match(gold: DataFrame, pred: DataFrame, by_tags: bool = False) -> DataFrame:
    """n, n_exact, exact_match over common sentences: equal strict spans, or equal tags."""
    ids = common_ids(gold, pred)
    if by_tags:
        g, p = (x.join(ids, "sid", "left_semi").select("sid", "i", F.col("tag").alias(k)) for x, k in ((gold, "g"), (pred, "p")))
        wrong = g.join(p, ["sid", "i"], "full").where(~F.col("g").eqNullSafe(F.col("p"))).select("sid").distinct()
    else:
        g, p = (spans(x.join(ids, "sid", "left_semi")) for x in (gold, pred))
        wrong = span_pairs(g, p).where("not (in_gold and in_pred)").select("sid").distinct()
    n = ids.join(wrong.withColumn("wrong", F.lit(1)), "sid", "left").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("wrong").isNull()).alias("n_exact"))
    return n.select("n", "n_exact", F.round(F.coalesce(F.try_divide("n_exact", "n"), F.lit(0.0)), 6).alias("exact_match"))


def span_errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(sid, s, e, kind) of missed (FN) and invented (FP) spans."""
    pairs = span_pairs(spans(gold), spans(pred))
    return pairs.where("in_gold <> in_pred").select("sid", "s", "e", F.when(F.col("in_gold"), "FN").otherwise("FP").alias("kind"))


def error_roles(gold: DataFrame, pred: DataFrame, roles: DataFrame) -> DataFrame:
    """(kind, role, n) of the tokens inside wrong spans; roles: (sid, i, role), none: no_role."""
    inside = span_errors(gold, pred).select("sid", "kind", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i"))
    return inside.join(roles, ["sid", "i"], "left").groupBy("kind", F.coalesce("role", F.lit("no_role")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def report(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: counts of sentences, tokens and length mismatches, span and token F1, exact match, over the sentences of both.

    Gold and prediction are joined once by place; one window finds where spans end, one aggregate counts a sentence.
    """
    both = gold.select("sid", "i", F.col("tag").alias("g")).join(pred.select("sid", "i", F.col("tag").alias("p")), ["sid", "i"], "full")
    after = Window.partitionBy("sid").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    ends = lambda c: F.first(F.when(F.coalesce(F.col(c), F.lit(O)) != I, F.col("i")), ignorenulls=True).over(after)  # noqa: E731  null: the sentence's end
    x = both.withColumn("g_end", ends("g")).withColumn("p_end", ends("p"))
    opens = lambda c: F.coalesce(F.col(c) == B, F.lit(False))
    has, math = {c: F.col(c).isNotNull() for c in "gp"}, {c: F.col(c) != O for c in "gp"}
    by_sentence = x.groupBy("sid").agg(
        F.count("g").alias("n_g"), F.count("p").alias("n_p"), F.count_if(has["g"] & has["p"]).alias("n_both"),
        F.count_if(opens("g")).alias("s_g"), F.count_if(opens("p")).alias("s_p"), F.count_if(opens("g") & opens("p") & F.col("g_end").eqNullSafe(F.col("p_end"))).alias("s_both"),
        F.count_if(math["g"] & math["p"]).alias("t_both"), F.count_if(math["g"] & has["p"]).alias("t_g"), F.count_if(math["p"] & has["g"]).alias("t_p"),
    ).where("n_g > 0 and n_p > 0")
    exact = (F.col("s_g") == F.col("s_both")) & (F.col("s_p") == F.col("s_both"))
    total = by_sentence.agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if(F.col("n_g") != F.col("n_p")).alias("length_mismatches"), F.coalesce(F.sum("n_both"), F.lit(0)).alias("n_tokens"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("s_g", "s_p", "s_both", "t_g", "t_p", "t_both")), F.count_if(exact).alias("n_exact"))
    scored = lambda k: F.round(f1(F.col(f"{k}_both"), F.col(f"{k}_p") - F.col(f"{k}_both"), F.col(f"{k}_g") - F.col(f"{k}_both"))["f1"], 6)
    return total.select("n_sentences", "length_mismatches", "n_tokens", scored("s").alias("span_f1"), scored("t").alias("token_f1"), F.round(F.coalesce(F.try_divide("n_exact", "n_sentences"), F.lit(0.0)), 6).alias("exact_match"))


def over_seeds(metrics: DataFrame, config: str = "config", value: str = "value") -> DataFrame:
    """Mean and population deviation per configuration."""
    return metrics.groupBy(config).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"))
