"""Writers. Parquet is the canonical store; delimited files use the readers' one dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanspark.operators.bio import assemble, encode
from spanspark.sources.readers import CSV

#: The readers' dialect for writing: an empty text is a quoted nothing, so it isn't taken for a null.
CSV_OUT = {k: v for k, v in CSV.items() if k != "multiLine"} | {"emptyValue": '""'}


def tagged_table(tags: DataFrame, path: str) -> None:
    tags.write.mode("overwrite").options(**CSV_OUT, sep="\t").csv(path)


def append_split(tags: DataFrame, path: str, split: str = "train_llm") -> None:
    """Adds rows as one split; running it again replaces that split and no other."""
    tags.withColumn("split", F.lit(split)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split").parquet(path)


def dataset(tags: DataFrame, path: str) -> None:
    """Sentences as token and label arrays, partitioned by split."""
    wide = assemble(tags.withColumn("label", encode(F.col("tag")).cast("bigint")), "tok", "label")
    splits = tags.groupBy("sid").agg(F.min("split").alias("split"))
    wide.join(splits, "sid").withColumnsRenamed({"tok": "tokens", "label": "ner_tags"}).write.mode("overwrite").partitionBy("split").parquet(path)


def dropped_sentences(tags: DataFrame, stored: DataFrame) -> DataFrame:
    """Sentence ids on one side only; empty if nothing was lost or added."""
    a, b = tags.select("sid").distinct(), stored.select("sid").distinct()
    return a.subtract(b).unionAll(b.subtract(a))


def features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def detector_rows(rows: DataFrame) -> DataFrame:
    """Space-delimited lines: sid pos tok deprel tag."""
    return rows.select("sid", "pos", F.concat_ws(" ", F.col("sid").cast("string"), F.col("pos").cast("string"), "tok", "deprel", "tag").alias("line"))


def detector_json(rows: DataFrame) -> DataFrame:
    """One JSON object per sentence."""
    each = F.array_sort(F.collect_list(F.struct("pos", "tok", "tag")))
    return rows.groupBy("sid").agg(each.alias("t")).select("sid", F.to_json(F.struct(F.col("sid"), F.transform("t", lambda x: x["tok"]).alias("tokens"), F.transform("t", lambda x: x["tag"]).alias("bio"))).alias("json"))


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def samples_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").options(**CSV_OUT).csv(path)


def markdown(metrics: DataFrame, title: str, limit: int = 1000) -> str:
    """A report table of a metrics frame; limit bounds what a report shows."""
    rows = metrics.limit(limit).collect()
    head = metrics.columns
    body = ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]
    return "\n".join([f"# {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body])
