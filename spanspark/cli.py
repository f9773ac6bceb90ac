"""Command line: evaluate, detect, convert, prompts, export. ``python -m spanspark.cli COMMAND --help`` lists the options."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio, corpus, dependency, evaluate, features, lexicon, models
from spanspark.sources import readers, sinks


def table(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A tagged table from a delimited file or from Parquet."""
    if path.rstrip("/").endswith((".tsv", ".csv", ".txt")):
        return readers.bio_table(spark, path, split)
    rows = readers.require(spark.read.parquet(path), ("sid", "i", "tok", "tag"))
    return rows.where(F.col("split") == split) if split else rows


def scores(gold: DataFrame, pred: DataFrame, pooled: bool = False) -> dict:
    """The metrics record of a prediction."""
    gold, pred = gold.persist(), pred.persist()
    whole = evaluate.report(gold, pred).first()
    keys = ("precision", "recall", "f1", "tp", "fp", "fn")
    span, token = evaluate.span_scores(gold, pred, pooled).first(), evaluate.token_scores(gold, pred).first()
    out = {"n_sentences": whole.n_sentences, "n_tokens": whole.n_tokens, "length_mismatches": whole.length_mismatches, "missing": evaluate.missing_ids(gold, pred).count()}
    out |= {"span_f1": {k: span[k] for k in keys}, "token_f1": {k: token[k] for k in (*keys, "tn")}, "exact_match": whole.exact_match}
    gold.unpersist()
    pred.unpersist()
    return out


def self_test(gold: DataFrame) -> list[str]:
    """What a perfect, an empty and a noise prediction should score and don't."""
    wrong = []
    same = scores(gold, gold)
    if gold.where(F.col("tag") == bio.B).isEmpty():
        return wrong
    if not (same["span_f1"]["f1"] == same["token_f1"]["f1"] == same["exact_match"] == 1.0):
        wrong.append(f"a perfect prediction scores {same}")
    none = scores(gold, gold.withColumn("tag", F.lit(bio.O)))
    if none["span_f1"]["f1"] or none["token_f1"]["recall"]:
        wrong.append(f"an empty prediction scores {none}")
    noise = scores(gold, models.random_tags(gold.drop("tag")))
    if noise["span_f1"]["f1"] > 0.5:
        wrong.append(f"noise scores {noise}")
    return wrong


def cmd_evaluate(spark: SparkSession, a: argparse.Namespace) -> int:
    gold = table(spark, a.gold, a.split)
    if a.self_test:
        wrong = self_test(gold)
        print("\n".join(wrong) or "ok")
        return int(bool(wrong))
    found = {"split": a.split, **scores(gold, table(spark, a.pred, a.split), a.pooled)}
    print(json.dumps(found, ensure_ascii=False))
    if a.json:
        sinks.metrics_json(spark.createDataFrame([(json.dumps(found),)], "metrics string"), a.json)
    return 0


def detected(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(sid, pos, tok, deprel, tag): by parsed tokens where there are any, else by the lexicon alone."""
    lex = readers.lexicon(spark, a.markers, a.gazetteer)
    if a.parses:
        tokens = readers.conllu(spark, a.parses)
        numbers = corpus.with_ordinals(tokens.select("file", "sent").distinct(), "file", "sent", name="sid")
        tokens = tokens.join(numbers.withColumn("sid", F.col("sid") + 1), ["file", "sent"])
        return dependency.detect(tokens, [tuple(r)[:5] for r in lex.orderBy("ord").collect()])
    given = sys.stdin.read() if a.input == "-" else a.text
    words = readers.interactive(spark, given, a.input, a.default).select("sid", F.posexplode(T.words_and_marks(F.col("text"))).alias("k", "tok"))
    words = words.withColumn("mark", ~F.col("tok").rlike(rf"[{T.WORD_CLASS}]"))
    placed = words.where("not mark").withColumn("i", F.row_number().over(Window.partitionBy("sid").orderBy("k")) - 1)
    longest = lexicon.patterns(lex).agg(F.max("size")).first()[0] or 1
    tags = bio.paint(lexicon.detect_lexical(placed.select("sid", "i", "tok"), lex, longest).select("sid", "s", "e"), placed)
    out = tags.select("sid", "k", "tok", "tag")
    if a.include_punct:
        out = out.unionByName(words.where("mark").select("sid", "k", "tok", F.lit(bio.O).alias("tag")))
    return out.select("sid", (F.row_number().over(Window.partitionBy("sid").orderBy("k")) - 1).alias("pos"), "tok", F.lit("UNK").alias("deprel"), "tag")


def cmd_detect(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = detected(spark, a)
    named = rows.withColumn("sid", F.format_string(f"{a.sentence_id_prefix}_%04d", "sid"))
    out = sinks.detector_json(named).select(F.col("json").alias("value")) if a.json else sinks.detector_rows(named).orderBy("sid", "pos").select(F.col("line").alias("value"))
    if a.output:
        out.write.mode("overwrite").text(a.output)
    else:
        for r in out.toLocalIterator():
            print(r.value)
    return 0


def cmd_convert(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = readers.trimmed_lines(spark, a.input).withColumn("reason", T.reject_reason(F.col("line")))
    lines.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).count().show(truncate=False)
    kept = corpus.with_ordinals(lines.where("reason is null").select("file", "n", F.col("line").alias("text")), "file", "n", name="sid")
    tags = bio.punct_outside(bio.parse_tagged(kept)).withColumn("sid", F.format_string("llm_%04d", "sid")).withColumn("source", F.lit("llm_generated"))
    bad = bio.violations(tags).select("sid").distinct()
    tags = tags.join(bad, "sid", "left_anti").select("sid", "i", "tok", "tag", "source")
    tags.write.mode("overwrite").parquet(a.output)
    if a.append_to_merged:
        sinks.append_split(spark.read.parquet(a.output), a.merged_path)
    return 0


def prompt(formulas: Sequence[str]) -> str:
    return "\n".join([f"Write one lecture sentence for each of these {len(formulas)} spoken formulas; put it between [MATH] and [/MATH]."] + [f"{k}. {f}" for k, f in enumerate(formulas, 1)])


def cmd_prompts(spark: SparkSession, a: argparse.Namespace) -> int:
    """Prompts of formulas drawn by hash without replacement; asking a model is left to the caller."""
    s2l = readers.pronunciations(spark, a.s2l_path).select("pronunciation").distinct()
    for batch in range(a.num_batches):
        own = s2l.orderBy(F.md5(F.concat_ws("|", "pronunciation", F.lit(str(a.seed)), F.lit(str(batch)))), "pronunciation").limit(a.batch_size)
        print(json.dumps({"batch_idx": batch, "prompt": prompt([r.pronunciation for r in own.collect()])}, ensure_ascii=False))
    return 0


def cmd_export(spark: SparkSession, a: argparse.Namespace) -> int:
    tags = table(spark, a.input)
    bad = readers.bio_violations(tags)
    if not bad.isEmpty():
        bad.groupBy("rule").count().show(truncate=False)
        return 1
    sinks.dataset(tags, a.output)
    return int(not sinks.dropped_sentences(tags, spark.read.parquet(a.output)).isEmpty())


def cmd_export_features(spark: SparkSession, a: argparse.Namespace) -> int:
    """One row of features per token; words that the lexicon names get their role."""
    tags = table(spark, a.input)
    roles = features.best_role(features.role_confidence(readers.lexicon(spark, a.markers)))
    sinks.features(features.feature_table(tags, roles), a.output)
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanspark", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        c = sub.add_parser(name)
        c.set_defaults(run=run)
        for flag, kind in options:
            c.add_argument(flag, **kind)

    text, need, flag = {}, {"required": True}, {"action": "store_true"}
    command("evaluate", cmd_evaluate, ("--pred", text), ("--gold", need), ("--split", text), ("--json", text), ("--self-test", flag), ("--pooled", flag))
    command("detect", cmd_detect, ("--text", text), ("--input", text), ("--default", {"default": ""}), ("--output", text), ("--sentence-id-prefix", {"default": "input"}), ("--markers", need), ("--gazetteer", text), ("--parses", text), ("--include-punct", flag), ("--json", flag))
    command("convert-generated", cmd_convert, ("--input", need), ("--output", need), ("--append-to-merged", flag), ("--merged-path", text))
    command("prompts", cmd_prompts, ("--num-batches", {"type": int, "default": 50}), ("--batch-size", {"type": int, "default": 10}), ("--s2l-path", need), ("--seed", {"type": int, "default": 42}))
    command("export", cmd_export, ("--input", need), ("--output", need))
    command("export-features", cmd_export_features, ("--input", need), ("--output", need), ("--markers", need))
    return p


def main(args: Sequence[str] | None = None) -> int:
    a = parser().parse_args(args)
    return a.run(SparkSession.builder.appName("spanspark").getOrCreate(), a)


if __name__ == "__main__":
    sys.exit(main())
