"""The registry of queries, and the tables that they all start from, in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A lexicon over the frequent words of the test languages: ord, id, pattern, role, match_type, confidence.
LEXICON = (
    (0, "m00", "the", "RELATION", "phrase", "high"), (1, "m01", "of the", "STRUCTURE", "phrase", "medium"), (2, "m02", "of", "OPERATOR", "phrase", "high"),
    (3, "m03", "and", "CONNECTIVE", "phrase", "low"), (4, "m04", "with", "BOUNDARY_AMBIGUOUS", "exact", "medium"), (5, "m05", "le", "VARIABLE", "phrase", "high"),
    (6, "m06", "la", "OBJECT", "lemma", "medium"), (7, "m07", "der", "CONSTANT", "phrase", "high"), (8, "m08", "die", "QUANTIFIER", "phrase", "low"),
    (9, "m09", "et", "CONNECTIVE", "phrase", "medium"), (10, "m10", "in the", "RELATION", "phrase", "medium"), (11, "m11", "that", "DISCOURSE_START", "phrase", "medium"),
    (12, "m12", "de", "OBJECT", "phrase", "low"), (13, "m13", "was", "END_CONTEXT", "phrase", "low"), (14, "m14", "for", "NEGATIVE_CONTEXT", "phrase", "high"),
    (15, "m15", "the", "OBJECT", "phrase", "low"), (16, "m16", "is (to|a)", "OPERATOR", "regex", "medium"), (17, "m17", "de la", "STRUCTURE", "phrase", "high"),
    (18, "m18", "x la", "OBJECT", "phrase", None), (19, "m19", "et de", "QUANTIFIER", "lemma", "unsure"), (20, "m20", "(was|et) (the|la|de)", "RELATION", "regex", "low"), (21, "m21", "that (the|is)", "NEGATIVE_CONTEXT", "regex", "low"),
)
LEXICON_SCHEMA = "ord int, id string, pattern string, role string, match_type string, confidence string"
MATH = ("the", "of", "le", "la", "der", "die")
LONGEST = 2
values = lambda rows: ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)

CLEAN = r"lower(regexp_replace({t}, '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g'))"
RUN = "PARTITION BY sid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND "
#: Common tables of the oracles; DuckDB computes only those that a query names.
BASE = rf"""WITH
sent AS (SELECT conv_id * 100 + turn AS sid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
arr AS (SELECT sid, conv_id, turn, role, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS toks FROM sent),
tok AS (SELECT sid, conv_id, turn, role, (unnest(range(len(toks))))::INT AS i, unnest(toks) AS tok FROM arr),
clean AS (SELECT *, {CLEAN.format(t="tok")} AS w FROM tok),
flag AS (SELECT *, w IN ({", ".join(f"'{m}'" for m in MATH)}) AS math FROM clean),
lex(ord, id, pattern, role, match_type, confidence) AS (VALUES {values(LEXICON)}),
brk AS (SELECT *, regexp_matches(tok, '[.!?;]')::INT AS own, sum(regexp_matches(tok, '[.!?;]')::INT) OVER ({RUN} CURRENT ROW) AS broken FROM flag),
prv AS (SELECT *, last_value(CASE WHEN math THEN i END IGNORE NULLS) OVER ({RUN} 1 PRECEDING) AS p, last_value(CASE WHEN math THEN broken END IGNORE NULLS) OVER ({RUN} 1 PRECEDING) AS pb FROM brk),
isl2 AS (SELECT *, sum((p IS NULL OR i - p - 1 > 2 OR broken - own - pb > 0)::INT) OVER ({RUN} CURRENT ROW) AS k FROM prv WHERE math),
isl0 AS (SELECT *, sum((p IS NULL OR i - p - 1 > 0 OR broken - own - pb > 0)::INT) OVER ({RUN} CURRENT ROW) AS k FROM prv WHERE math),
span2 AS (SELECT sid, min(i) AS s, max(i) + 1 AS e FROM isl2 GROUP BY sid, k),
span0 AS (SELECT sid, min(i) AS s, max(i) + 1 AS e FROM isl0 GROUP BY sid, k),
bio2 AS (SELECT f.sid, f.conv_id, f.role, f.i, f.tok, f.w, f.math, CASE WHEN x.s IS NULL THEN 'O' WHEN x.s = f.i THEN 'B-MATH' ELSE 'I-MATH' END AS tag FROM flag f LEFT JOIN span2 x ON f.sid = x.sid AND f.i >= x.s AND f.i < x.e),
bio0 AS (SELECT f.sid, f.conv_id, f.role, f.i, f.tok, f.w, f.math, CASE WHEN x.s IS NULL THEN 'O' WHEN x.s = f.i THEN 'B-MATH' ELSE 'I-MATH' END AS tag FROM flag f LEFT JOIN span0 x ON f.sid = x.sid AND f.i >= x.s AND f.i < x.e),
pred AS (SELECT * FROM bio0 WHERE sid % 7 <> 3),
raw AS (SELECT sid, i, tok, CASE WHEN (sid * 31 + i * 17) % 11 < 5 THEN 'O' WHEN (sid * 31 + i * 17) % 11 < 8 THEN 'I-MATH' ELSE 'B-MATH' END AS tag FROM tok)
"""


RECURSIVE = BASE.replace("WITH", "WITH RECURSIVE", 1)


def query(name: str, sql: str | None = None, base: str = BASE):
    """Registers a query; sql continues the common tables."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = base + (("," + body[5:]) if body.startswith("WITH ") else body)
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sentences(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("sid"), "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def tokens(spark, sf) -> DataFrame:
    """(sid, conv_id, turn, role, i, tok)"""
    return sentences(spark, sf).select("sid", "conv_id", "turn", "role", F.posexplode(T.words(F.col("text"))).alias("i", "tok"))


def flagged(spark, sf) -> DataFrame:
    w = T.clean_word(F.col("tok"))
    return tokens(spark, sf).withColumn("w", w).withColumn("math", F.col("w").isin(*MATH))


def gold(spark, sf) -> DataFrame:
    return bio.gap_merge(flagged(spark, sf), 2)


def pred_all(spark, sf) -> DataFrame:
    return bio.gap_merge(flagged(spark, sf), 0)


def pred(spark, sf) -> DataFrame:
    """A predictor without gaps that lacks some sentences."""
    return pred_all(spark, sf).where("sid % 7 <> 3")


def raw_tags(spark, sf) -> DataFrame:
    """Tags by arithmetic, with every kind of irregularity."""
    r = (F.col("sid") * 31 + F.col("i") * 17) % 11
    return tokens(spark, sf).select("sid", "i", "tok", F.when(r < 5, "O").when(r < 8, "I-MATH").otherwise("B-MATH").alias("tag"))


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(LEXICON), LEXICON_SCHEMA)


def long(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]
