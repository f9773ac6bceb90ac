"""Vocabulary, roles and token features for sequence models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio

# Stop words and limits of the corpus vocabulary.
STOPWORDS = tuple("в на от и с по к до из при для за не ни что как это то бы же ли но а у о е".split())
MIN_COUNT, MIN_LENGTH, CORPUS_ROLE = 50, 2, "S2L_MATH"


def role_confidence(lexicon: DataFrame) -> DataFrame:
    """(word, role, conf): each word's best confidence per role; regex patterns, negative contexts and words of one letter stay out.

    A missing or unknown confidence is the lowest, a missing role is NONE.
    """
    usable = lexicon.withColumn("role", F.coalesce("role", F.lit("NONE"))).where((F.col("role") != "NEGATIVE_CONTEXT") & ~F.col("pattern").rlike(T.REGEX_CHARS))
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    each = usable.select(F.explode(T.words(F.col("pattern"))).alias("w"), "role", level.alias("conf")).select(T.clean_word(F.col("w")).alias("word"), "role", "conf")
    return each.where(F.length("word") >= MIN_LENGTH).groupBy("word", "role").agg(F.max("conf").alias("conf"))


def corpus_words(tokens: DataFrame, min_count: int = MIN_COUNT, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(word, n) of the frequent words that are long enough and no stop words.

    Tokens are counted as they stand, so that each distinct one is cleaned once.
    """
    distinct = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("times"))
    w = distinct.select(T.clean_word(F.col("tok")).alias("word"), "times").where(F.length("word") >= MIN_LENGTH)
    stop = tokens.sparkSession.createDataFrame([(s,) for s in stopwords], "word string")
    return w.groupBy("word").agg(F.sum("times").alias("n")).where(F.col("n") >= min_count).join(F.broadcast(stop), "word", "left_anti")


def vocabulary(lexicon: DataFrame, corpus: DataFrame) -> DataFrame:
    """(word, role, conf): lexicon words, and corpus words that the lexicon lacks."""
    known = role_confidence(lexicon)
    return known.unionByName(corpus.join(known, "word", "left_anti").select("word", F.lit(CORPUS_ROLE).alias("role"), F.lit(1).alias("conf")))


def best_role(vocab: DataFrame) -> DataFrame:
    """(word, role): the most confident role, of equals the first by name."""
    return vocab.groupBy("word").agg(F.min_by("role", F.struct(-F.col("conf"), F.col("role"))).alias("role"))


def with_role(tokens: DataFrame, roles: DataFrame) -> DataFrame:
    """tokens with word, role (none: NONE) and is_math."""
    own = tokens.withColumn("word", T.clean_word(F.col("tok")))
    return own.join(roles, "word", "left").withColumn("is_math", F.col("role").isNotNull()).withColumn("role", F.coalesce("role", F.lit("NONE")))


def surface(tokens: DataFrame) -> DataFrame:
    prefix, suffix = T.affixes(F.col("tok"))
    return tokens.select("*", F.lower("tok").alias("lower"), T.word_shape(F.col("tok")).alias("shape"), prefix.alias("prefix3"), suffix.alias("suffix3"), *(c.alias(k) for k, c in T.surface_flags(F.col("tok")).items()))


def with_side(tokens: DataFrame, side: DataFrame) -> DataFrame:
    """tokens with dep and rule_tag from side(sid, i, dep, rule_tag, row_no): the last row of a key; blanks and gaps get defaults."""
    last = side.groupBy("sid", "i").agg(F.max_by("dep", "row_no").alias("dep"), F.max_by("rule_tag", "row_no").alias("rule_tag"))
    fill = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    return tokens.join(last, ["sid", "i"], "left").select(*tokens.columns, fill("dep", "UNK"), fill("rule_tag", "O"))


def feature_table(tokens: DataFrame, roles: DataFrame, postag: bool = False, dep: bool = False, rule_tag: bool = False) -> DataFrame:
    """One row per token with its own features and its neighbours'; the flags add the optional columns."""
    own = bio.edges(surface(with_role(tokens, roles)))
    around = ("lower", "is_math", "role", *(c for c, on in (("postag", postag), ("dep", dep), ("rule_tag", rule_tag)) if on))
    drop = [c for c, on in (("postag", postag), ("dep", dep), ("rule_tag", rule_tag)) if not on and c in own.columns]
    return bio.context(own.drop(*drop), around)


def coverage(tokens: DataFrame, side: DataFrame, by: Column) -> DataFrame:
    """(split, total, hits, ratio): tokens with a side feature."""
    has = side.select("sid", "i").distinct().withColumn("hit", F.lit(1))
    n = tokens.withColumn("split", by).join(has, ["sid", "i"], "left").groupBy("split").agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("hits"))
    return n.withColumn("ratio", F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6))
