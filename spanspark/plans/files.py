"""Queries over files: what is written in a format comes back the same (S, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio, evaluate, features
from spanspark.plans.registry import LEXICON, flagged, gold, long, pred, query, sentences, table, tokens
from spanspark.plans.relations import PAIRS, SCORE, SIDE_SQL, SPLIT3, side, split3
from spanspark.plans.texts import BLOCK_SQL, REASON, TAGGED_SQL, blocks, tagged_lines
from spanspark.sources import readers, sinks
from spanspark.storage import scratch
from spanspark.streaming import append_log


def text_file(df, path: str, column: str = "line") -> str:
    """One file with the rows in order of n."""
    df.coalesce(1).sortWithinPartitions("n").select(F.col(column).alias("value")).write.text(path)
    return path


MATH_SQL = "CASE WHEN (conv_id + i) % 3 = 0 THEN 'MathFormula' ELSE '_' END"


def webanno_files(spark, sf, with_ids: bool) -> str:
    """A folder per conversation, sentences with and without id lines; written over the session's partitions, whose tasks move their own folders into place."""
    path = scratch(spark, "webanno")
    t = flagged(spark, sf)
    name = F.when((F.col("conv_id") + F.col("i")) % 3 == 0, "MathFormula").otherwise("_")
    row = F.concat_ws("\t", F.concat((F.col("turn") + 1).cast("string"), F.lit("-"), (F.col("i") + 1).cast("string")), F.lit("0-0"), "tok", name, F.lit("_"), F.lit("_"), F.when(F.col("math"), "x.inception/1").otherwise("_"), F.lit(""))
    body = t.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc"), "turn", (F.col("i") + 3).alias("n"), row.alias("line"))
    s = sentences(spark, sf).where("text rlike '[^ \\\\s]'").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("doc"), "turn", "sid", F.regexp_replace("text", r"\s+", " ").alias("text"))
    head = [(0, F.lit("")), (1, F.concat(F.lit("#Sentence.id="), F.col("sid").cast("string"))), (2, F.concat(F.lit("#Text="), F.col("text")))]
    lines = s.select("doc", "turn", F.explode(F.array(*(F.struct(F.lit(n).alias("n"), v.alias("line")) for n, v in head if with_ids or n != 1))).alias("x")).select("doc", "turn", "x.n", "x.line")
    both = lines.unionByName(body).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc").sortWithinPartitions("doc", "turn", "n")
    both.select("doc", "line").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("doc").text(path)
    return path


@query("s1_webanno_scan", f"SELECT 'doc=c' || conv_id AS doc, sid::VARCHAR AS sent, i::BIGINT AS i, tok, {MATH_SQL} <> '_' OR math AS math FROM flag")
def s1(spark, sf):
    return readers.webanno(spark, webanno_files(spark, sf, True)).select("doc", "sent", *long("i"), "tok", "math")


@query("s1_webanno_scan_by_prefix", f"SELECT 'doc=c' || conv_id AS doc, (turn + 1)::VARCHAR AS sent, i::BIGINT AS i, tok, {MATH_SQL} <> '_' OR math AS math FROM flag")
def s1_prefix(spark, sf):
    return readers.webanno(spark, webanno_files(spark, sf, False), by_prefix=True).select("doc", "sent", *long("i"), "tok", "math")


@query("s2_directory_enumeration", "SELECT DISTINCT 'doc=c' || conv_id AS doc FROM tok")
def s2(spark, sf):
    return readers.webanno(spark, webanno_files(spark, sf, True)).select("doc").distinct()


@query("s3_tsv_scan", "SELECT doc_id, lang, source FROM documents")
def s3(spark, sf):
    path = scratch(spark, "tsv")
    sinks.tagged_table(table(spark, sf, "documents").select("doc_id", "lang", "source"), path)
    return readers.delimited(spark, path, "doc_id bigint, lang string, source string")


def stored_bio(spark, sf) -> str:
    path = scratch(spark, "bio")
    rows = gold(spark, sf).select(F.col("sid").cast("string").alias("sid"), "i", "tok", "tag", F.lit("conversations").alias("source"), split3().alias("split"))
    sinks.tagged_table(rows, path)
    return path


@query("s4_validating_scan", "SELECT sid::VARCHAR AS sid, string_agg(tok, ' ' ORDER BY i) AS line FROM bio2 GROUP BY sid")
def s4(spark, sf):
    rows = readers.bio_table(spark, stored_bio(spark, sf))
    bad = readers.bio_violations(rows).select("sid").distinct()
    return bio.assemble(rows.join(bad, "sid", "left_anti"), "tok").select("sid", F.array_join("tok", " ").alias("line"))


@query("s5_split_scan", f"SELECT sid::VARCHAR AS sid, i::BIGINT AS i, tag FROM bio2 WHERE {SPLIT3} = 'val'")
def s5(spark, sf):
    return readers.bio_table(spark, stored_bio(spark, sf), "val").select("sid", *long("i"), "tag")


@query("s6_mask_scan", "SELECT (row_number() OVER (ORDER BY sid) - 1)::BIGINT AS n, text AS sentence, CASE WHEN sid % 2 = 0 THEN '0110' ELSE '1' END AS mask FROM sent")
def s6(spark, sf):
    path = scratch(spark, "mask")
    rows = sentences(spark, sf).select("sid", F.col("text").alias("sentence"), F.when(F.col("sid") % 2 == 0, "0110").otherwise("1").alias("mask"))
    sinks.samples_csv(rows.coalesce(1).sortWithinPartitions("sid").select("sentence", "mask"), path)
    return readers.mask_table(spark, path).select(*long("n"), "sentence", "mask")


@query("s7_tagged_scan", TAGGED_SQL + " SELECT sid, line AS sentence_tagged FROM tl")
def s7(spark, sf):
    path = scratch(spark, "tagged")
    sinks.samples_csv(tagged_lines(spark, sf).select("sid", F.col("line").alias("sentence_tagged")), path)
    return readers.delimited(spark, path, "sid bigint, sentence_tagged string", ",")


@query("s8_line_scan", r"SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, count(*)::BIGINT AS n FROM sent WHERE regexp_matches(text, '\S') GROUP BY 1")
def s8(spark, sf):
    rows = sentences(spark, sf).select(F.col("sid").alias("n"), F.concat(F.lit("  "), F.regexp_replace("text", r"\s+", " "), F.lit(" ")).alias("line"))
    return readers.trimmed_lines(spark, text_file(rows, scratch(spark, "lines"))).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("s9_pronunciation_scan", "SELECT trim(toks[1]) AS pronunciation, text AS sentence_normalized FROM arr WHERE sid % 4 <> 0 AND len(toks) > 0")
def s9(spark, sf):
    path = scratch(spark, "s2l")
    first = F.get(T.words(F.col("text")), F.lit(0))
    rows = sentences(spark, sf).select(F.when(F.col("sid") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), first)).alias("pronunciation"), F.col("text").alias("sentence_normalized")).where("pronunciation is not null")
    sinks.samples_csv(rows, path)
    return readers.pronunciations(spark, path)


def lexicon_file(spark, first: str | None = None) -> str:
    lines = [first] if first else []
    for _, ident, pattern, role, kind, _ in LEXICON:
        lines += [f"- id: {ident}", "  patterns:", f'    - "{pattern}"', f"  role: {role}", f"  match_type: {kind}"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    return text_file(df, scratch(spark, "lexicon"))


@query("s10_lexicon_scan", "SELECT ord::BIGINT AS ord, id, pattern, role, match_type FROM lex")
def s10(spark, sf):
    return readers.lexicon(spark, lexicon_file(spark)).select(*long("ord"), "id", "pattern", "role", "match_type")


@query("s11_lexicon_fallback", "SELECT id, pattern, role, 'medium' AS confidence FROM lex")
def s11(spark, sf):
    """The file's first line is no YAML, so the line reader takes over."""
    return readers.lexicon(spark, lexicon_file(spark, "version: [1, 2")).select("id", "pattern", "role", "confidence")


@query("s12_gazetteer", "SELECT id, pattern, role FROM lex UNION ALL SELECT 'gazetteer_' || k, p, 'STRUCTURE' FROM (VALUES (0, 'sum of'), (2, 'root of')) AS g(k, p)")
def s12(spark, sf):
    lines = ["entries:", '  - phrase: "sum of"', "    domain: x", '  - phrase: "--"', '  - phrase: "root of"']
    path = text_file(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), scratch(spark, "gazetteer"))
    return readers.lexicon(spark, lexicon_file(spark), path).select("id", "pattern", "role")


@query("s13_response_blocks", BLOCK_SQL + r" SELECT regexp_replace(block, '^\s+|\s+$', '', 'g') AS block FROM blk")
def s13(spark, sf):
    path = scratch(spark, "responses")
    line = F.concat(F.lit("---"), F.col("item_id").cast("string"), F.lit("---\n"), F.col("block"))
    text_file(blocks(spark, sf).select(F.col("item_id").alias("n"), line.alias("line")), path)
    return readers.response_blocks(spark, path).select("block")


@query("s14_side_feature_scan", SIDE_SQL + " SELECT t.sid::VARCHAR AS sid, t.i::BIGINT AS i, coalesce(nullif(trim(s.dep), ''), 'UNK') AS dep, coalesce(nullif(trim(s.rule_tag), ''), 'O') AS rule_tag FROM tok t LEFT JOIN side s USING (sid, i)")
def s14(spark, sf):
    path = scratch(spark, "side")
    sinks.tagged_table(side(spark, sf).select(F.col("sid").cast("string").alias("sid"), "i", F.lit("x").alias("tok"), "dep", "rule_tag"), path)
    t = tokens(spark, sf).select(F.col("sid").cast("string").alias("sid"), "i")
    return features.with_side(t, readers.side_features(spark, path)).select("sid", *long("i"), "dep", "rule_tag")


DATASET = f"SELECT sid, {SPLIT3} AS split, string_agg(tok, ' ' ORDER BY i) AS tokens, string_agg(CASE tag WHEN 'O' THEN '0' WHEN 'B-MATH' THEN '1' ELSE '2' END, '' ORDER BY i) AS labels FROM bio2 GROUP BY ALL"


def dataset(spark, sf):
    path = scratch(spark, "dataset")
    sinks.dataset(gold(spark, sf).withColumn("split", split3()), path)
    return spark.read.parquet(path)


def flat(df):
    return df.select("sid", "split", F.array_join("tokens", " ").alias("tokens"), F.array_join("ner_tags", "").alias("labels"))


@query("s15_dataset_scan", f"SELECT * FROM ({DATASET}) WHERE split = 'test'")
def s15(spark, sf):
    return flat(dataset(spark, sf).where("split = 'test'"))


@query("s16_interactive_text", "SELECT * FROM (VALUES (0::BIGINT, 'let x be'), (2::BIGINT, 'of the sum')) AS t(sid, text)")
def s16(spark, sf):
    return readers.interactive(spark, text=" let x be \n \nof the sum\n")


@query("s16_interactive_file", r"SELECT (row_number() OVER (ORDER BY sid) - 1)::BIGINT AS sid, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM sent WHERE regexp_matches(text, '\S')")
def s16_file(spark, sf):
    rows = sentences(spark, sf).where(r"text rlike '[^ \\s]'").select(F.col("sid").alias("n"), F.concat(F.lit(" "), F.regexp_replace("text", r"\s+", " ")).alias("line"))
    return readers.interactive(spark, path=text_file(rows, scratch(spark, "interactive")))


@query("k1_tagged_table", f"SELECT sid::VARCHAR AS sid, i::BIGINT AS i, tok, tag, 'conversations' AS source, {SPLIT3} AS split FROM bio2")
def k1(spark, sf):
    return readers.bio_table(spark, stored_bio(spark, sf)).withColumn("i", F.col("i").cast("bigint"))


@query("k2_append_split", f"SELECT split, count(*)::BIGINT AS n FROM (SELECT {SPLIT3} AS split FROM bio2 UNION ALL SELECT 'train_llm' FROM bio0) GROUP BY split")
def k2(spark, sf):
    path = scratch(spark, "merged")
    gold(spark, sf).select("sid", "i", "tok", "tag", split3().alias("split")).write.partitionBy("split").parquet(path)
    for _ in range(2):  # the second run replaces the first one's rows
        sinks.append_split(bio.gap_merge(flagged(spark, sf), 0).select("sid", "i", "tok", "tag"), path)
    return spark.read.parquet(path).groupBy(F.col("split").cast("string").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("k3_dataset", DATASET)
def k3(spark, sf):
    return flat(dataset(spark, sf))


@query("k4_feature_table", "SELECT sid, i::BIGINT AS i, lower(tok) AS lower, left(tok, 3) AS prefix3, length(tok)::BIGINT AS length FROM tok")
def k4(spark, sf):
    path = scratch(spark, "features")
    sinks.features(features.surface(tokens(spark, sf)), path)
    return spark.read.parquet(path).select("sid", *long("i"), "lower", "prefix3", "length")


@query("k5_side_features", SIDE_SQL + " SELECT sid::VARCHAR AS sid, i::BIGINT AS i, dep, rule_tag FROM side")
def k5(spark, sf):
    path = scratch(spark, "side")
    sinks.tagged_table(side(spark, sf).select(F.col("sid").cast("string").alias("sid"), "i", F.lit("x").alias("tok"), "dep", "rule_tag"), path)
    return readers.side_features(spark, path).select("sid", *long("i"), "dep", "rule_tag")


@query("k6_detector_rows", "SELECT sid, i::BIGINT AS pos, sid || ' ' || i || ' ' || tok || ' dep ' || tag AS line FROM bio2")
def k6(spark, sf):
    return sinks.detector_rows(gold(spark, sf).select("sid", F.col("i").cast("bigint").alias("pos"), "tok", F.lit("dep").alias("deprel"), "tag"))


@query("k6_detector_json", """SELECT sid, '{"sid":' || sid || ',"tokens":[' || string_agg(to_json(tok)::VARCHAR, ',' ORDER BY i) || '],"bio":[' || string_agg('"' || tag || '"', ',' ORDER BY i) || ']}' AS json FROM bio2 GROUP BY sid""")
def k6_json(spark, sf):
    return sinks.detector_json(gold(spark, sf).select("sid", F.col("i").alias("pos"), "tok", "tag"))


@query("k7_metrics_json", "SELECT lang AS config, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def k7(spark, sf):
    path = scratch(spark, "metrics")
    sinks.metrics_json(table(spark, sf, "documents").groupBy(F.col("lang").alias("config")).agg(F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("config string, n bigint").json(path)


@query("k8_sample_csv", "SELECT item_id, text FROM benchmark")
def k8(spark, sf):
    path = scratch(spark, "samples")
    sinks.samples_csv(table(spark, sf, "benchmark").select("item_id", "text"), path)
    return readers.delimited(spark, path, "item_id bigint, text string", ",")


@query("k9_append_log", TAGGED_SQL + f", ln AS (SELECT sid, regexp_replace(line, '\\s+', ' ', 'g') AS line FROM tl) SELECT sid::BIGINT AS batch_idx, trim(line) AS line FROM ln WHERE {REASON} IS NULL")
def k9(spark, sf):
    """Raw records go in as JSON files, kept lines come out of the stream; a second start finds nothing new."""
    base = scratch(spark, "log")
    rows = tagged_lines(spark, sf).select(F.col("sid").cast("int").alias("batch_idx"), F.lit("m").alias("model"), F.array().cast("array<string>").alias("sampled_formulas"), F.concat(F.lit("1. "), F.regexp_replace("line", r"\s+", " "), F.lit("\n\n")).alias("response"))
    rows.write.json(f"{base}/in")
    for _ in range(2):
        append_log.follow(append_log.incoming(spark, f"{base}/in"), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.option("recursiveFileLookup", True).parquet(f"{base}/out/kept").select(*long("batch_idx"), "line")


@query("k10_report", "SELECT * FROM (VALUES (0::BIGINT, '# documents'), (1, ''), (2, '| lang | n | mean_chars |'), (3, '|---|---|---|')) AS h(n, line) UNION ALL SELECT 3 + row_number() OVER (ORDER BY lang), '| ' || lang || ' | ' || count(*) || ' | ' || (sum(n_chars) // count(*)) || ' |' FROM documents GROUP BY lang")
def k10(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.expr("sum(n_chars) div count(1)").alias("mean_chars")).orderBy("lang")
    return spark.createDataFrame(list(enumerate(sinks.markdown(n, "documents").split("\n"))), "n bigint, line string")


@query("stream_event_sessions", "WITH o AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events), k AS (SELECT *, sum((p IS NULL OR ts >= p + INTERVAL 30 MINUTE)::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, count(*)::BIGINT AS n FROM k GROUP BY user_id, k")
def stream_sessions(spark, sf):
    return append_log.sessions(table(spark, sf, "events").select("user_id", "ts")).select("user_id", "n")


@query("evaluate_stored", PAIRS + f", n AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn) SELECT {SCORE} FROM n")
def evaluate_stored(spark, sf):
    """Both tables are written as delimited files and read back before they are scored."""
    paths = []
    for tags in (gold(spark, sf), pred(spark, sf)):
        paths.append(scratch(spark, "tags"))
        own = tags.select(F.col("sid").cast("string").alias("sid"), "i", "tok", "tag", F.lit("conversations").alias("source"), F.lit("test").alias("split"))
        sinks.tagged_table(own, paths[-1])
    return evaluate.span_scores(*(readers.bio_table(spark, p) for p in paths))
