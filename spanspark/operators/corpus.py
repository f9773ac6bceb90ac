"""Corpus building: kept sentences, splits, union, profile, reconciliation, and sampled augmentation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanspark.operators.bio import B, O, spans
from spanspark.storage import with_ordinals

SPLITS = ("test", "val", "train_clean", "train_noisy", "train_llm")
# Token-length buckets (from, to, weight).
LENGTH_BUCKETS = ((3, 6, 0.2), (7, 12, 0.3), (13, 18, 0.3), (19, 25, 0.2))


def with_span_only(tags: DataFrame) -> DataFrame:
    """Sentences that hold an opened span."""
    return tags.join(tags.where(F.col("tag") == B).select("sid").distinct(), "sid", "left_semi")


def hash_order(key: str, seed: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))


def hash_split(ids: DataFrame, n_test: int = 50, seed: str = "42") -> DataFrame:
    """ids with split: the n_test first by hash are test, the rest val; a permutation that any engine can repeat."""
    rank = F.row_number().over(Window.orderBy(hash_order("sid", seed), "sid"))
    first = ids.orderBy(hash_order("sid", seed), "sid").limit(n_test).withColumn("rank", rank).select("sid", F.lit("test").alias("split"))
    return ids.join(F.broadcast(first), "sid", "left").select("sid", F.coalesce("split", F.lit("val")).alias("split"))


def merged(sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of tagged sources: name to (tags, split)."""
    out = None
    for name, (tags, split) in sources.items():
        part = tags.select("sid", "i", "tok", "tag", F.lit(name).alias("source"), F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def profile(tags: DataFrame) -> DataFrame:
    """(split, sentences, tokens, math_tokens, spans) and a TOTAL line, in one pass."""
    n = tags.rollup("split").agg(F.countDistinct("sid").alias("sentences"), F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tag") != O).alias("math_tokens"), F.count_if(F.col("tag") == B).alias("spans"))
    return n.withColumn("split", F.coalesce("split", F.lit("TOTAL")))


def span_lengths(tags: DataFrame, lenient: bool = False) -> DataFrame:
    return spans(tags, lenient).select("sid", "s", (F.col("e") - F.col("s")).cast("bigint").alias("length"))


def spans_per_sentence(tags: DataFrame) -> DataFrame:
    """(n_spans, sentences), sentences without spans included."""
    return tags.groupBy("sid").agg(F.count_if(F.col("tag") == B).alias("n_spans")).groupBy("n_spans").agg(F.count(F.lit(1)).alias("sentences"))


def reconcile(actual: DataFrame, expected: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, actual, status) over the keys of both."""
    both = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full")
    return both.withColumn("status", F.when(F.col("expected").isNull(), "unexpected").when(F.col("actual").isNull(), "missing").when(F.col("expected") == F.col("actual"), "ok").otherwise("differs"))


def split_conflicts(tags: DataFrame) -> DataFrame:
    """Sentences that stand in more than one split."""
    return tags.groupBy("sid").agg(F.countDistinct("split").alias("splits")).where("splits > 1")


def numbered(rows: DataFrame, prefix: str, order: str, keep: Column | None = None) -> DataFrame:
    """rows with id prefix_0000 in order; with keep the rejected rows take no number."""
    own = rows if keep is None else rows.where(keep)
    return with_ordinals(own, order).withColumn("id", F.format_string(f"{prefix}_%04d", "ordinal")).drop("ordinal")


def length_bucket(n: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, (lo, hi, _) in enumerate(LENGTH_BUCKETS):
        out = F.when(n.between(lo, hi), k).otherwise(out)
    return out


def stratified(rows: DataFrame, n: Column, total: int, key: str, seed: str) -> DataFrame:
    """About total rows with the buckets' shares; shares of empty buckets go to the others. Rows are chosen by hash."""
    b = rows.withColumn("bucket", length_bucket(n)).where("bucket is not null")
    weights = F.element_at(F.array(*(F.lit(w) for _, _, w in LENGTH_BUCKETS)), F.col("bucket") + 1)
    present = {r.bucket: r.w for r in b.select("bucket", weights.alias("w")).distinct().collect()}  # one row per bucket
    out = b.limit(0)
    for bucket, w in sorted(present.items()):
        quota = int(total * w / sum(present.values()) + 0.5)
        out = out.union(b.where(F.col("bucket") == bucket).orderBy(hash_order(key, seed), key).limit(quota))
    return out


def templates(tags: DataFrame) -> DataFrame:
    """(sid, n, item, slot): sentences with each span as one numbered slot (item null) and other tokens as they are."""
    order = Window.partitionBy("sid").orderBy("i")
    x = tags.where((F.col("tag") == B) | (F.col("tag") == O))
    slot = F.when(F.col("tag") == B, F.sum((F.col("tag") == B).cast("int")).over(order) - 1)
    return x.select("sid", (F.row_number().over(order) - 1).alias("n"), F.when(F.col("tag") == O, F.col("tok")).alias("item"), slot.alias("slot"))


def inject(items: DataFrame, fillers: DataFrame, variants: int, n_fillers: int) -> DataFrame:
    """(sid, variant, i, tok, tag): every slot of every variant filled by the filler (ord, text) that its hash names."""
    v = items.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", "sid", "variant", "slot")), 1, 8), 16, 10).cast("bigint"), F.lit(n_fillers))
    v = v.withColumn("ord", F.when(F.col("slot").isNotNull(), pick)).join(fillers, "ord", "left")
    parts = F.when(F.col("slot").isNull(), F.array("item")).otherwise(F.filter(F.split("text", r"\s+"), lambda x: x != ""))
    each = v.select("sid", "variant", "n", "slot", F.posexplode(parts).alias("j", "tok"))
    order = Window.partitionBy("sid", "variant").orderBy("n", "j")
    tag = F.when(F.col("slot").isNull(), O).when(F.col("j") == 0, B).otherwise("I-MATH")
    return each.select("sid", "variant", (F.row_number().over(order) - 1).alias("i"), "tok", tag.alias("tag"))


def carrier_counts(n_carriers: int, total: int) -> list[int]:
    """Even shares; the remainder goes to the first carriers."""
    share, rest = divmod(total, n_carriers)
    return [share + (k < rest) for k in range(n_carriers)]


def carried(fillers: DataFrame, carriers: list[tuple[str, ...]], total: int, n_fillers: int) -> DataFrame:
    """(n, prefix, text, suffix): total examples dealt evenly over carriers, each around the filler its number names."""
    spark = fillers.sparkSession
    rows, first = [], 0
    for parts, n in zip(carriers, carrier_counts(len(carriers), total), strict=True):
        k = parts.index("{MATH}")
        rows.append((first, n, " ".join(parts[:k]).strip(), " ".join(parts[k + 1 :]).strip()))
        first += n
    table = spark.createDataFrame(rows, "first int, count int, prefix string, suffix string").where("count > 0")
    each = table.select("prefix", "suffix", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)).alias("n"))
    return each.withColumn("ord", F.pmod(F.col("n") * 7 + 3, F.lit(n_fillers)).cast("bigint")).join(fillers, "ord").select("n", "prefix", "text", "suffix")


def retry_with_fewer(make: Callable[[int], DataFrame], fits: Column, variants: Sequence[int], most_skipped: int) -> tuple[int, DataFrame, int]:
    """(variants, kept, skipped): the first number of variants at which at most most_skipped rows don't fit, else the last."""
    for n in variants:
        rows = make(n)
        skipped = rows.where(~fits).count()
        if skipped <= most_skipped:
            break
    return n, rows.where(fits), skipped


def backoff(call: Callable[[str], str], prompt: str, tries: int = 5, first_wait: float = 5.0, wait: Callable[[float], None] | None = None) -> str:
    """A generator's answer; after a refusal for its rate (RuntimeError) it is asked again, waiting twice as long each time."""
    import time

    for k in range(tries):
        try:
            return call(prompt)
        except RuntimeError:
            if k == tries - 1:
                raise
            (wait or time.sleep)(first_wait * 2**k)
    raise ValueError("no tries")
