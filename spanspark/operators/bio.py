"""BIO sequences: tags from masks and gaps, spans from tags, checks, context. Keys: sid, i (0-based), tok, tag.

Every window here has the same partitioning and order (sid, i), so one exchange and one sort serve a chain of them.
Spans are [s, e).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from spanspark.functions import text as T

B, I, O = "B-MATH", "I-MATH", "O"  # noqa: E741
MAX_GAP = 2


def order() -> WindowSpec:
    """The one window of sequences; made on call, as a window needs a running session."""
    return Window.partitionBy("sid").orderBy("i")


def before() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, -1)


def to_here() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def mask_to_bio(tokens: DataFrame, bit: str = "bit") -> DataFrame:
    last = F.lag(bit).over(order())
    return tokens.withColumn("tag", F.when(F.col(bit) == 0, O).when(F.coalesce(last, F.lit(0)) == 0, B).otherwise(I))


def gap_spans(tokens: DataFrame, max_gap: int = MAX_GAP, flag: str = "math") -> DataFrame:
    """(sid, s, e): flagged tokens joined over at most max_gap others, none of which ends a sentence."""
    breaks = F.col("tok").rlike(T.SENTENCE_BREAK).cast("int")
    seen = tokens.withColumn("own", breaks).withColumn("broken", F.sum("own").over(to_here()))
    last = seen.withColumn("p", F.last(F.when(F.col(flag), F.col("i")), ignorenulls=True).over(before())).withColumn("pb", F.last(F.when(F.col(flag), F.col("broken")), ignorenulls=True).over(before()))
    new = F.col("p").isNull() | (F.col("i") - F.col("p") - 1 > max_gap) | (F.col("broken") - F.col("own") - F.col("pb") > 0)
    runs = last.where(F.col(flag)).withColumn("k", F.sum(new.cast("int")).over(to_here()))
    return runs.groupBy("sid", "k").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e")).drop("k")


def gap_merge(tokens: DataFrame, max_gap: int = MAX_GAP, flag: str = "math") -> DataFrame:
    """tokens with tag: the same islands, painted over their whole hull with windows only.

    What comes next is found by leads over nulls, in one pass; a frame up to the sentence's end is worked out anew for each token.
    """
    breaks = F.col("tok").rlike(T.SENTENCE_BREAK).cast("int")
    at = F.when(F.col(flag), F.col("i"))
    x = tokens.withColumn("own", breaks).withColumn("broken", F.sum("own").over(to_here()))
    x = x.withColumn("p", F.last(at, ignorenulls=True).over(before())).withColumn("pb", F.last(F.when(F.col(flag), F.col("broken")), ignorenulls=True).over(before()))
    own = F.when(F.col(flag), F.struct(F.col("i").alias("n"), (F.col("broken") - F.col("own")).alias("nb")))
    x = x.withColumn("_own", own).withColumn("_next", F.coalesce("_own", F.expr("lead(_own) IGNORE NULLS OVER (PARTITION BY sid ORDER BY i)")))
    x = x.withColumn("n", F.col("_next.n")).withColumn("nb", F.col("_next.nb"))
    joined = F.col("p").isNotNull() & F.col("n").isNotNull() & (F.col("n") - F.col("p") - 1 <= max_gap) & (F.col("nb") - F.col("pb") <= 0)
    tag = F.when(F.col(flag), F.when(joined, I).otherwise(B)).otherwise(F.when(joined, I).otherwise(O))
    return x.withColumn("tag", tag).drop("own", "broken", "p", "pb", "_own", "_next", "n", "nb")


def starts(lenient: bool) -> Column:
    last = F.lag("tag").over(order())
    opened = F.col("tag") == B
    return opened | ((F.col("tag") == I) & (last.isNull() | (last == O))) if lenient else opened


def spans(tags: DataFrame, lenient: bool = False) -> DataFrame:
    """(sid, s, e) of tagged runs; an I without a B before it is ignored, or opens a span if lenient."""
    x = tags.withColumn("st", starts(lenient)).withColumn("k", F.sum((F.col("st") | (F.col("tag") == O)).cast("int")).over(to_here()))
    runs = x.where(F.col("tag") != O).groupBy("sid", "k").agg(F.min_by("st", "i").alias("st"), F.min("i").alias("s"), (F.max("i") + 1).alias("e"))
    return runs.where("st").select("sid", "s", "e")


def violations(tags: DataFrame, at_start: bool = True) -> DataFrame:
    """(sid, i): an I after an O, or at a sentence's start."""
    last = F.lag("tag").over(order())
    bad = (F.col("tag") == I) & (F.coalesce(last, F.lit(O if at_start else B)) == O)
    return tags.withColumn("bad", bad).where("bad").select("sid", "i")


def punct_outside(tags: DataFrame) -> DataFrame:
    """Punctuation becomes O; the next I that loses its opener to it becomes B."""
    p = F.col("tok").rlike(T.PUNCT_OUTSIDE)
    x = tags.withColumn("p", p).withColumn("np", F.coalesce(F.sum((~F.col("p")).cast("int")).over(before()), F.lit(0)))
    run = Window.partitionBy("sid", "np").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("lost", F.coalesce(F.max(F.col("p") & (F.col("tag") != O)).over(run), F.lit(False)))
    return x.withColumn("tag", F.when(F.col("p"), O).when((F.col("tag") == I) & F.col("lost"), B).otherwise(F.col("tag"))).drop("p", "np", "lost")


def context(tokens: DataFrame, columns: tuple[str, ...], offsets: tuple[int, ...] = (-2, -1, 1, 2)) -> DataFrame:
    """Each column's neighbours; outside the sentence BOS and EOS, or False for flags."""
    kinds = dict(tokens.dtypes)
    out = tokens
    for k in offsets:
        for c in columns:
            beyond = False if kinds[c] == "boolean" else ("BOS" if k < 0 else "EOS")
            out = out.withColumn(f"{c}_{'m' if k < 0 else 'p'}{abs(k)}", (F.lag if k < 0 else F.lead)(c, abs(k), beyond).over(order()))
    return out


def edges(tokens: DataFrame) -> DataFrame:
    whole = Window.partitionBy("sid")
    return tokens.withColumn("bos", F.row_number().over(order()) == 1).withColumn("eos", F.row_number().over(order()) == F.count(F.lit(1)).over(whole))


def assemble(tags: DataFrame, *columns: str) -> DataFrame:
    """One row per sentence, with each column as an array in token order."""
    rows = F.array_sort(F.collect_list(F.struct("i", *columns)))
    wide = tags.groupBy("sid").agg(rows.alias("rows"))
    return wide.select("sid", *(F.col(f"rows.{c}").alias(c) for c in columns))


def paint(spans_: DataFrame, tokens: DataFrame) -> DataFrame:
    """tokens with the tag of their span; of two spans over a token the later one (by start) counts."""
    inside = spans_.select("sid", "s", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i")).groupBy("sid", "i").agg(F.max("s").alias("s"))
    out = tokens.join(inside, ["sid", "i"], "left")
    return out.withColumn("tag", F.when(F.col("s").isNull(), O).when(F.col("s") == F.col("i"), B).otherwise(I)).drop("s")


def parse_tagged(lines: DataFrame, text: str = "text") -> DataFrame:
    """(sid, i, tok, tag) of [MATH]…[/MATH] texts; odd parts between tags are spans of their own."""
    parts = lines.select("sid", F.posexplode(F.split(text, T.TAGS)).alias("part", "chunk"))
    each = parts.select("sid", "part", F.posexplode(T.words(F.col("chunk"))).alias("j", "tok"))
    whole = Window.partitionBy("sid").orderBy("part", "j")
    tag = F.when(F.col("part") % 2 == 0, O).when(F.col("j") == 0, B).otherwise(I)
    return each.select("sid", (F.row_number().over(whole) - 1).alias("i"), "tok", tag.alias("tag"))


def reject_reasons(lines: DataFrame, text: str = "text") -> DataFrame:
    """(sid, reason) of tagged lines(sid, text): the first failed check (counts, nesting, leak, broken tags); null: keep."""
    return lines.select("sid", F.coalesce(T.reject_reason(F.col(text)), F.when(breaks(F.col(text)), "bio")).alias("reason"))


def breaks(line: Column) -> Column:
    """Whether the tags of a tagged line, with punctuation outside, hold an I after an O or at the start; worked out inside the line.

    The steps are those of parse_tagged, punct_outside and violations: a place is the part's number, the token and its number there.
    """
    token = lambda part, tok, j: F.struct(F.when(part % 2 == 0, O).when(j == 0, B).otherwise(I).alias("tag"), tok.rlike(T.PUNCT_OUTSIDE).alias("p"))
    parts = F.transform(F.split(line, T.TAGS), lambda chunk, part: F.transform(T.words(chunk), lambda tok, j: token(part, tok, j)))

    def step(now: Column, x: Column) -> Column:
        tag = F.when(x["p"], O).when((x["tag"] == I) & now["lost"], B).otherwise(x["tag"])
        return F.struct(tag.alias("last"), (x["p"] & (now["lost"] | (x["tag"] != O))).alias("lost"), (now["broken"] | ((tag == I) & (now["last"] == O))).alias("broken"))

    none = F.struct(F.lit(O).alias("last"), F.lit(False).alias("lost"), F.lit(False).alias("broken"))
    return F.aggregate(F.flatten(parts), none, step)["broken"]


def encode(tag: Column) -> Column:
    return F.element_at(F.create_map(*(x for k, v in ((O, 0), (B, 1), (I, 2)) for x in (F.lit(k), F.lit(v)))), tag)


def decode(code: Column) -> Column:
    return F.when(code == 0, O).when(code == 1, B).when(code == 2, I)
