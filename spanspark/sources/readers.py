"""Readers: explicit schemas, no inference; line files are read in splits, and the order of their lines from where each split starts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.storage import with_ordinals

BIO_SCHEMA = "sid string, i int, tok string, tag string, source string, split string"
TAGS, SPLITS = ("O", "B-MATH", "I-MATH"), ("test", "val", "train_clean", "train_noisy", "train_llm")
#: Tasks a core that list the folders of annotation files.
LISTING_TASKS = 8
#: One dialect for every delimited file that the engine writes and reads.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "nullValue": "\x00", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t") -> DataFrame:
    return spark.read.options(**CSV, sep=sep).schema(schema).csv(path)


def below(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all files under path, however many folders hold them.

    One root is given to Spark instead of a glob of all folders, which the planner compares again and again, and the folders
    are listed by a few tasks a core instead of up to 10,000. The listing is done when this returns.
    """
    name, conf = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.conf
    now = conf.get(name)
    conf.set(name, str(min(int(now), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        return spark.read.option("recursiveFileLookup", True).text(path, lineSep="\n")
    finally:
        conf.set(name, now)


def lines(spark: SparkSession, path: str, nested: bool = False) -> DataFrame:
    """(file, n, line); n sorts a file's lines: where their split of the file starts, and their place in it. nested: of all files under path.

    Lines are read in order inside a split, so no file has to fit a row or a task.
    """
    whole = below(spark, path) if nested else spark.read.text(path, lineSep="\n")
    each = whole.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.regexp_replace("value", "\r$", "").alias("line"))
    return each.select("file", F.struct("at", F.monotonically_increasing_id().alias("id")).alias("n"), "line")


def trimmed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) without outer blanks, empty lines left out; where order doesn't matter nothing is sorted."""
    return lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).where("line <> ''")


def bio_violations(rows: DataFrame) -> DataFrame:
    """(rule, sid) of what a tagged table breaks: unknown tags or splits, and sentences in several splits."""
    bad_tag = rows.where(~F.col("tag").isin(*TAGS) | F.col("tag").isNull()).select(F.lit("tag").alias("rule"), "sid")
    bad_split = rows.where(~F.col("split").isin(*SPLITS) | F.col("split").isNull()).select(F.lit("split").alias("rule"), "sid")
    several = rows.groupBy("sid").agg(F.countDistinct("split").alias("n")).where("n > 1").select(F.lit("several_splits").alias("rule"), "sid")
    return bad_tag.union(bad_split).union(several).distinct()


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bio_table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A tagged table; the split filter reaches the scan."""
    rows = require(delimited(spark, path, BIO_SCHEMA), ("sid", "i", "tok", "tag"))
    return rows.where(F.col("split") == split) if split else rows


def pronunciations(spark: SparkSession, path: str) -> DataFrame:
    rows = delimited(spark, path, "pronunciation string, sentence_normalized string", ",")
    return rows.withColumn("pronunciation", F.trim("pronunciation")).where("pronunciation <> ''")


def mask_table(spark: SparkSession, path: str) -> DataFrame:
    """(n, sentence, mask) in file order."""
    rows = delimited(spark, path, "sentence string, mask string", ",")
    return with_ordinals(rows, name="n").select("n", "sentence", "mask")


def webanno(spark: SparkSession, path: str, by_prefix: bool = False) -> DataFrame:
    """(doc, sent, sid_text, i, tok, math) of the annotation files under path (or that a glob names); a file's folder is its doc.

    A sentence opens at ``#Sentence.id=``; its last ``#Text=`` line counts. With by_prefix the part of the token id
    before its dash names the sentence instead, for files without sentence ids. Rows with fewer than 5 fields are skipped.
    """
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(spark, path, nested=True).withColumn("f", F.split("line", "\t"))
    token = ~F.startswith("line", F.lit("#")) & (F.trim("line") != "") & (F.size("f") > 4)
    x = x.withColumn("token", token)
    opened = F.regexp_extract("line", r"^#Sentence\.id=(.*)$", 1)
    named = F.when(F.col("token"), F.regexp_extract("line", r"^([0-9]+)-", 1)) if by_prefix else F.when(F.startswith("line", F.lit("#Sentence.id=")), opened)
    x = x.withColumn("sent", F.last(named, ignorenulls=True).over(order))
    caption = F.when(F.startswith("line", F.lit("#Text=")), F.substring("line", 7, 1 << 30))
    if by_prefix:
        x = x.withColumn("text", F.last(caption, ignorenulls=True).over(order))
    else:
        x = x.withColumn("text", F.last(caption, ignorenulls=True).over(Window.partitionBy("file", "sent").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = x.where(F.col("token") & F.col("sent").isNotNull())
    place = F.row_number().over(Window.partitionBy("file", "sent").orderBy("n")) - 1
    i = F.coalesce(F.regexp_extract("line", r"^[0-9]+-([0-9]+)", 1).try_cast("int") - 1, place)
    folder = F.substring_index(F.substring_index("file", "/", -2), "/", 1)  # a pattern would try every place of a long path, for each line
    doc = F.regexp_replace(folder, r"(\.txt|\.conllu)$", "")
    math = T.is_math_mark(F.col("f")[3], F.coalesce(F.get("f", F.lit(6)), F.lit("")))
    return rows.select(doc.alias("doc"), "sent", F.col("text").alias("sid_text"), i.alias("i"), F.col("f")[2].alias("tok"), math.alias("math"))


def conllu(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, idx, text, lemma, upos, head, deprel) of 10-column parses; head counts from 0, null at a root."""
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(spark, path).withColumn("f", F.split("line", "\t")).withColumn("sent", F.sum((F.trim("line") == "").cast("int")).over(order))
    rows = x.where((F.size("f") == 10) & F.col("f")[0].rlike("^[0-9]+$"))
    head = F.col("f")[6].try_cast("int")
    return rows.select("file", "sent", (F.col("f")[0].cast("int") - 1).alias("idx"), F.col("f")[1].alias("text"), F.col("f")[2].alias("lemma"), F.col("f")[3].alias("upos"), F.when(head > 0, head - 1).alias("head"), F.col("f")[7].alias("deprel"))


def conll2002(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent, i, tok, tag) of token–tag lines; blank lines part sentences."""
    order = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    x = lines(spark, path).withColumn("sent", F.sum((F.trim("line") == "").cast("int")).over(order)).where("trim(line) <> ''")
    f = F.split("line", r"\s+")
    return x.select("file", "sent", (F.row_number().over(Window.partitionBy("file", "sent").orderBy("n")) - 1).alias("i"), f[0].alias("tok"), F.element_at(f, -1).alias("tag"))


def response_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, block) of whole response files cut at ---n--- lines."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    each = whole.select("file", F.posexplode(F.split("value", r"---\s*[0-9]+\s*---")).alias("n", "block"))
    return each.withColumn("block", F.regexp_replace("block", r"^\s+|\s+$", "")).where("block <> ''")


def lexicon_entries(text: str) -> list[tuple[int, str, str, str, str, str]]:
    """(ord, id, pattern, role, match_type, confidence), one per pattern, from marker YAML.

    What the full parser can't read, or where it isn't installed, goes to a line reader, which knows ids, roles, quoted
    patterns and match types and takes every confidence for medium.
    """
    entries: list[dict] = []
    try:
        data = yaml_of(text)
        entries = data if isinstance(data, list) else data.get("markers") or data["entries"]
        entries = [dict(e) for e in entries]
    except Exception:  # noqa: BLE001  whatever is wrong with the file
        entries, now = [], {}
        for line in text.splitlines():
            if m := re.match(r"\s*-\s+id:\s*(\S+)", line):
                now = {"id": m[1].strip("\"'"), "patterns": [], "confidence": "medium"}
                entries.append(now)
            elif now and (m := re.match(r"\s*(role|match_type):\s*(\S+)", line)):
                now[m[1]] = m[2].strip("\"'")
            elif now and (m := re.match(r"\s*-\s+\"(.*)\"\s*$", line)):
                now["patterns"].append(m[1])
    flat = [(str(e.get("id", "")), str(p), e.get("role"), e.get("match_type", "phrase"), e.get("confidence")) for e in entries for p in e.get("patterns") or []]
    return [(k, *x) for k, x in enumerate(flat)]


def yaml_of(text: str):
    import yaml

    return yaml.safe_load(text)


def gazetteer_phrases(text: str) -> list[tuple[str, str]]:
    """(id, phrase) from gazetteer YAML: a list ``entries`` of mappings with a ``phrase``; phrases without words fall away."""
    listed = (yaml_of(text) or {}).get("entries") or []
    return [(f"gazetteer_{k}", str(p)) for k, e in enumerate(listed) if re.search(r"\w", p := e.get("phrase") or "")]


def small_file(spark: SparkSession, path: str) -> str:
    """A parameter file's text, read through Spark, so any store will do."""
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())


def lexicon(spark: SparkSession, path: str, gazetteer: str | None = None) -> DataFrame:
    """The lexicon with an optional gazetteer file, whose phrases are STRUCTURE."""
    rows = lexicon_entries(small_file(spark, path))
    rows += [(len(rows) + k, ident, p, "STRUCTURE", "phrase", "medium") for k, (ident, p) in enumerate(gazetteer_phrases(small_file(spark, gazetteer)) if gazetteer else ())]
    return spark.createDataFrame(rows, "ord int, id string, pattern string, role string, match_type string, confidence string")


def side_features(spark: SparkSession, path: str) -> DataFrame:
    """(sid, i, tok, dep, rule_tag, row_no); features.with_side applies defaults and last-wins."""
    return delimited(spark, path, "sid string, i int, tok string, dep string, rule_tag string").withColumn("row_no", F.monotonically_increasing_id())


def interactive(spark: SparkSession, text: str | None = None, path: str | None = None, fallback: str = "") -> DataFrame:
    """(sid, text): a given text before a file before a fallback, one row per non-empty line."""
    if text is None and path is not None:
        numbered_ = with_ordinals(lines(spark, path).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")), "file", "n", name="sid")
        return numbered_.where("line <> ''").select("sid", F.col("line").alias("text"))
    given = (text if text is not None else fallback).splitlines()
    return spark.createDataFrame([(n, x.strip()) for n, x in enumerate(given) if x.strip()], "sid bigint, text string")


