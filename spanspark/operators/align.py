"""Alignment of two tokenisations: by characters, by a dynamic programme over a mask, with a positional fast path."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanspark.functions.text import alnum_chars
from spanspark.storage import bound_batches

LETTERS = "a-zA-Zа-яА-ЯёЁ"
PUNCT = re.compile(r"^[,.!?;:]+$")


def char_votes(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(sid, i, j): for each of our tokens the other's token that shares most of its characters, null if none.

    Both sides' letters and digits get running numbers; equal characters of equal number vote; of equals the first voted wins.
    Characters stay in their tokens: both sides' tokens lie in one order by the number of their first character, and from one
    start to the next a single pair of tokens votes. Joins of tokens are never broadcast, as a scan's size says little of them.
    """
    whole = lambda df, name: df.select("sid", F.lit(name).alias("side"), F.col("i").cast("bigint").alias("k"), F.array_join(alnum_chars(F.col("tok")), "").alias("chars"))
    both = whole(ours, "i").unionByName(whole(other, "j")).repartition("sid")
    n = F.length("chars")
    at = both.withColumn("at", F.coalesce(F.sum(n).over(Window.partitionBy("sid", "side").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(n > 0)
    order = Window.partitionBy("sid").orderBy("at")
    now = lambda side: F.last(F.when(F.col("side") == side, F.struct("k", "at", "chars")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    x = at.select("sid", "at", F.lead("at").over(order).alias("next"), now("i").alias("i"), now("j").alias("j"))
    x = x.withColumn("to", F.least("next", F.col("i.at") + F.length("i.chars"), F.col("j.at") + F.length("j.chars"))).where("i is not null and j is not null and to > at")
    part = lambda side: F.substring(f"{side}.chars", (F.col("at") - F.col(f"{side}.at") + 1).cast("int"), (F.col("to") - F.col("at")).cast("int"))
    x = x.select("sid", F.col("i.k").alias("i"), F.col("j.k").alias("j"), "at", "to", part("i").alias("a"), part("j").alias("b"))
    same = F.when(F.col("a") != F.col("b"), F.zip_with(alnum_chars(F.col("a")), alnum_chars(F.col("b")), lambda a, b: a == b))  # null: all of them
    x = x.withColumn("same", same)
    each = x.select("sid", "i", "j", F.when(F.col("same").isNull(), F.col("to") - F.col("at")).otherwise(F.size(F.filter("same", lambda v: v))).alias("n"), (F.col("at") + F.coalesce(F.array_position("same", F.lit(True)) - 1, F.lit(0))).alias("first")).where("n > 0")
    votes = each.groupBy("sid", "i", "j").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = votes.groupBy("sid", "i").agg(F.min_by("j", F.struct(-F.col("n"), F.col("first"))).cast(other.schema["i"].dataType).alias("j"))
    return ours.select("sid", "i").join(best.hint("merge"), ["sid", "i"], "left")


def align_tokens(ours: DataFrame, other: DataFrame) -> DataFrame:
    """(sid, i, j, how): by place where both sides have as many tokens, else by characters; no partner: j null."""
    n1, n2 = (df.groupBy("sid").agg(F.count(F.lit(1)).alias(k)) for df, k in ((ours, "n1"), (other, "n2")))
    same = n1.join(n2.hint("merge"), "sid").where("n1 = n2").select("sid").hint("merge")
    fast = ours.join(same, "sid", "left_semi").select("sid", "i", F.col("i").alias("j"), F.lit("place").alias("how"))
    slow = char_votes(ours.join(same, "sid", "left_anti"), other.join(same, "sid", "left_anti"))
    return fast.unionByName(slow.select("sid", "i", "j", F.when(F.col("j").isNull(), "none").otherwise("characters").alias("how")))


@lru_cache(100_000)
def likeness(token: str, math_words: frozenset, zero_words: frozenset) -> int:
    t = token.strip(".,!?;:²³")
    if not t:
        return -10
    for pattern, score in ((r"[0-9]+", 5), (r"[a-zA-Z][0-9]?", 5), (rf"[0-9]+[{LETTERS}]{{1,2}}|[{LETTERS}]{{1,2}}[0-9]+", 4)):
        if re.fullmatch(pattern, t):
            return score
    if t.lower() in math_words:
        return 3
    return 0 if len(t) <= 2 and t in zero_words else -2


def gluable(before: str, token: str) -> bool:
    """A token may join the one before: a mark after a word, or a short number next to short letters."""
    if PUNCT.match(token) and not PUNCT.match(before):
        return True
    digits, letters = re.compile("[0-9]+"), re.compile(f"[{LETTERS}]+")
    short = len(before) <= 3 and len(token) <= 3
    return short and bool((digits.fullmatch(before) and letters.fullmatch(token)) or (letters.fullmatch(before) and digits.fullmatch(token)))


def fit_mask(tokens: list[str], mask: str, math_words: frozenset, zero_words: frozenset) -> list[str] | None:
    """tokens glued so that there is one per mask bit, with the best score; null: impossible. Of equals the first found stays."""
    goal = len(mask)
    if len(tokens) <= goal:
        return list(tokens) if len(tokens) == goal else None
    values: dict[int, float] = {0: 0}
    ways: list[tuple[int, bytearray]] = []  # of each token: the least number of bits, and for each from there whether the token was glued
    for k, token in enumerate(tokens):
        score, glue = likeness(token, math_words, zero_words), k > 0 and gluable(tokens[k - 1], token)
        least = goal - (len(tokens) - k - 1)  # with fewer bits so far the rest can't fill the mask
        after: dict[int, tuple[float, bool]] = {}
        for j in sorted(values):
            value = values[j]
            moves = []
            if j < goal:
                moves.append((j + 1, value + (score if mask[j] == "1" else -score if score > 2 else 0), False))
            if glue:
                cost = 0 if not j or not PUNCT.match(token) else -8 if mask[j - 1] == "1" else 1
                moves.append((j, value + cost, True))
            for to, v, joined in moves:
                if to >= least and (to not in after or v > after[to][0]):
                    after[to] = (v, joined)
        if not after:
            return None
        low = min(after)
        ways.append((low, bytearray(max(after) - low + 1)))
        for j, (_, joined) in after.items():
            ways[-1][1][j - low] = joined
        values = {j: v for j, (v, _) in after.items()}
    if goal not in values:
        return None
    glued, j = set(), goal
    for k in range(len(tokens) - 1, -1, -1):
        low, merged = ways[k]
        if merged[j - low]:
            glued.add(k)
        else:
            j -= 1
    out: list[str] = []
    for k, token in enumerate(tokens):
        if k in glued and out:
            out[-1] += token
        else:
            out.append(token)
    return out


def align_mask(rows: DataFrame, math_words: tuple[str, ...], zero_words: tuple[str, ...]) -> DataFrame:
    """rows(sid, tokens, mask) with aligned: the glued tokens, null where none fit."""
    words, zeros = frozenset(math_words), frozenset(zero_words)

    @F.pandas_udf("array<string>")
    def aligned(tokens: pd.Series, mask: pd.Series) -> pd.Series:
        return pd.Series([fit_mask(list(t), m or "", words, zeros) if t is not None else None for t, m in zip(tokens, mask, strict=True)])

    return bound_batches(rows).withColumn("aligned", aligned("tokens", "mask"))
