"""Secret scans over a blob ledger, with DataFrame functions only.

Every version of a file is addressed by the SHA-256 of its text. A ledger keeps (blob, rule_version, spans) of every
blob scanned, clean ones with an empty array; a scan takes each blob that the ledger lacks under the current rule
version once, however many paths hold it, and findings are joined back to all paths. Spans are code points, end
exclusive. The text between two hits and the hits themselves give every hit's place: a running sum over their lengths,
taken per blob in the partition that already holds it.

Defined results: null text is the empty text (no spans); repeated rows and null paths give one row each; spans that start
at the same place stand in the order of the kinds; very long texts are scanned whole; an empty table gives no rows; other
columns are ignored; a ledger may be missing or empty. A text that many paths hold is joined to them without a task that
gathers its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanspark.llm.common import checkpointed, skew_join, text_of

# Kinds in order, the pattern of each, and what a hit must have besides.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES: tuple[tuple[str, str, int], ...] = (
    ("assign", ASSIGN, 12),  # group 2 of at least so many characters
    ("access", "AKIA[A-Z0-9]{14,}", 0),  # equal to the runs AKIA[A-Z0-9]+ of 18 characters or more
    ("hex", "[0-9a-f]{16,}", 0),  # equal to the runs [0-9a-f]+ of 16 characters or more
    ("github", "gh[opsur]_[A-Za-z0-9]{36,}", 0),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0),
)
BASE_KINDS = ("assign", "access", "hex")
RULE_VERSION = "2026-11-1"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def blobs(history: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob, text): every version with its content address."""
    return history.select(F.col(path).alias("path"), F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))


def hits(text: Column, rule: int) -> Column:
    """For one rule: the text before each hit, the hit, and the part that is measured."""
    _, pattern, least = RULES[rule]
    p = F.lit(pattern)
    found = F.struct(F.lit(rule).alias("kind"), F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(2 if least else 0)).alias("measured"))
    return F.when(text.rlike(pattern), found)


def scan(unseen: DataFrame) -> DataFrame:
    """(blob, spans) of each of the blobs (blob, text); a blob without secrets has an empty array."""
    text = F.col("text")
    by_rule = unseen.select("blob", F.explode_outer(F.filter(F.array(*(hits(text, k) for k in range(len(RULES)))), lambda x: x.isNotNull())).alias("x"))
    each = by_rule.select("blob", F.col("x.kind").alias("kind"), F.posexplode_outer(F.arrays_zip(F.col("x.before").alias("before"), F.col("x.hit").alias("hit"), F.col("x.measured").alias("measured"))).alias("at", "h"))
    so_far = Window.partitionBy("blob", "kind").orderBy("at")
    least = F.element_at(F.array(*(F.lit(n) for _, _, n in RULES)), F.col("kind") + 1)
    placed = each.select("blob", "kind", "at", F.length("h.before").alias("gap"), F.length("h.hit").alias("size"), F.length("h.measured").alias("measured")).withColumn("end", F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(so_far).cast("int"))
    real = F.col("size").isNotNull() & (F.col("measured") >= least)
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end")
    return placed.groupBy("blob").agg(F.sort_array(F.collect_list(F.when(real, span))).alias("spans"))


def update_ledger(history: DataFrame, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, spans): the blobs of history(path, blob, text) not yet scanned by these rules.

    Copies meet as one blob before and after the shuffle (a partial aggregate by content address), so a text that a
    third of all paths hold is sent once per task and scanned once.
    """
    unseen = history.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        unseen = unseen.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")
    return scan(unseen).select("blob", F.lit(rule_version).alias("rule_version"), "spans")


def findings(history: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) for every row of history(path, blob); no secrets: an empty array."""
    of_version = ledger.where(F.col("rule_version") == rule_version).select("blob", "spans")
    paths = checkpointed(history.select("path", "blob"))
    copies = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("copies"))
    found = skew_join(paths, of_version.join(copies, "blob"), "blob", "copies", paths.count(), "left")
    return found.select("path", "blob", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"))


def scan_history(history: DataFrame, path: str = "doc_id", text: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings of all paths, new ledger rows); append the latter to the ledger for the next scan."""
    versions = blobs(history, path, text)
    new = checkpointed(update_ledger(versions, ledger, rule_version))
    whole = new if ledger is None else new.unionByName(ledger)
    return findings(versions, whole, rule_version), new


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined, in the order of the spans."""
    names = F.array(*(F.lit(k) for k, _, _ in RULES))
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, the digest of the base spans, and all spans."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    return found.select(F.col("path").alias("doc_id"), *(count(k).alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
