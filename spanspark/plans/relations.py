"""Queries with joins (J), aggregates (A) and feature projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanspark.operators import align, bio, corpus, evaluate, features, lexicon, models
from spanspark.plans.registry import CLEAN, LONGEST, flagged, gold, long, pred, query, sentences, table, tokens
from spanspark.plans.registry import lexicon as lex
from spanspark.plans.sequences import NORMAL, UPOS, with_upos

SPLIT3 = "CASE sid % 3 WHEN 0 THEN 'train_clean' WHEN 1 THEN 'val' ELSE 'test' END"


def split3():
    k = F.col("sid") % 3
    return F.when(k == 0, "train_clean").when(k == 1, "val").otherwise("test")


@query("j1_semi_has_span", "SELECT sid, i::BIGINT AS i, tag FROM (SELECT *, bool_or(tag = 'B-MATH') OVER (PARTITION BY sid) AS held FROM bio2) WHERE held")
def j1(spark, sf):
    return corpus.with_span_only(gold(spark, sf)).select("sid", *long("i"), "tag")


@query("j2_common_ids", "SELECT sid FROM bio2 INTERSECT SELECT sid FROM pred")
def j2(spark, sf):
    return evaluate.common_ids(gold(spark, sf), pred(spark, sf))


@query("j4_token_pairs", "SELECT g.sid, g.i::BIGINT AS i, g.tag AS gold, p.tag AS pred FROM bio2 g JOIN pred p USING (sid, i)")
def j4(spark, sf):
    return evaluate.token_pairs(gold(spark, sf), pred(spark, sf)).select("sid", *long("i"), "gold", "pred")


SIDE_SQL = "WITH side AS (SELECT sid, i, CASE (sid + i) % 4 WHEN 0 THEN '' WHEN 1 THEN 'nmod' ELSE 'obj' END AS dep, CASE WHEN (sid + i) % 5 = 0 THEN ' ' ELSE 'B-MATH' END AS rule_tag FROM tok WHERE (sid * 3 + i) % 4 <> 2)"


def side(spark, sf):
    k = (F.col("sid") + F.col("i")) % 4
    x = tokens(spark, sf).where((F.col("sid") * 3 + F.col("i")) % 4 != 2)
    return x.select("sid", "i", F.when(k == 0, "").when(k == 1, "nmod").otherwise("obj").alias("dep"), F.when((F.col("sid") + F.col("i")) % 5 == 0, " ").otherwise("B-MATH").alias("rule_tag"), F.lit(0).alias("row_no"))


@query("j5_left_default", SIDE_SQL + " SELECT t.sid, t.i::BIGINT AS i, coalesce(nullif(trim(s.dep), ''), 'UNK') AS dep, coalesce(nullif(trim(s.rule_tag), ''), 'O') AS rule_tag FROM tok t LEFT JOIN side s USING (sid, i)")
def j5(spark, sf):
    return features.with_side(tokens(spark, sf), side(spark, sf)).select("sid", *long("i"), "dep", "rule_tag")


@query("j5_labels_default", "SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality, coalesce(l.toxic, 0)::BIGINT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j5_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).cast("bigint").alias("quality"), F.coalesce("toxic", F.lit(0)).cast("bigint").alias("toxic"))


VOCAB = rf"""WITH lp AS (SELECT coalesce(role, 'NONE') AS role, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS conf, unnest(string_split_regex(pattern, '\s+')) AS part FROM lex WHERE NOT regexp_matches(pattern, '[\[\]\\()|+?*{{}}]')),
lw AS (SELECT role, conf, {CLEAN.format(t='part')} AS word FROM lp WHERE role <> 'NEGATIVE_CONTEXT'),
rc AS (SELECT word, role, max(conf) AS conf FROM lw WHERE length(word) >= 2 GROUP BY word, role),
cw AS (SELECT {CLEAN.format(t='tok')} AS word, count(*) AS n FROM tok GROUP BY 1 HAVING count(*) >= 10 AND length(word) >= 2),
voc AS (SELECT word, role, conf FROM rc UNION ALL SELECT word, 'S2L_MATH', 1 FROM cw WHERE word NOT IN (SELECT word FROM rc)),
best AS (SELECT word, arg_min(role, (-conf, role)) AS role FROM voc GROUP BY word)"""


def vocab(spark, sf):
    return features.vocabulary(lex(spark), features.corpus_words(tokens(spark, sf), 10, ()))


@query("a6_word_frequency", VOCAB + " SELECT word, n::BIGINT AS n FROM cw")
def a6(spark, sf):
    return features.corpus_words(tokens(spark, sf), 10, ("zzz",))


@query("a6_document_word_frequency", rf"SELECT w, count(*)::BIGINT AS n FROM (SELECT lower(regexp_replace(unnest(string_split_regex(text, '\s+')), '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g')) AS w FROM documents) WHERE length(w) >= 2 GROUP BY w HAVING count(*) >= 50")
def a6_documents(spark, sf):
    from spanspark.functions import text as T

    return features.corpus_words(table(spark, sf, "documents").select(F.explode(T.words(F.col("text"))).alias("tok")), 50, ()).withColumnRenamed("word", "w")


@query("a7_max_confidence", VOCAB + " SELECT word, role, conf::BIGINT AS conf FROM rc")
def a7(spark, sf):
    return features.role_confidence(lex(spark)).select("word", "role", *long("conf"))


@query("j7_anti_join_union", VOCAB + " SELECT word, role, conf::BIGINT AS conf FROM voc")
def j7(spark, sf):
    return vocab(spark, sf).select("word", "role", *long("conf"))


@query("a8_role_pick", VOCAB + " SELECT word, role FROM best")
def a8(spark, sf):
    return features.best_role(vocab(spark, sf))


@query("j6_role_lookup", VOCAB + " SELECT c.sid, c.i::BIGINT AS i, coalesce(b.role, 'NONE') AS role, b.role IS NOT NULL AS is_math FROM clean c LEFT JOIN best b ON c.w = b.word")
def j6(spark, sf):
    t = tokens(spark, sf).drop("role")
    return features.with_role(t, features.best_role(vocab(spark, sf))).select("sid", *long("i"), "role", "is_math")


@query("p19_feature_projection", VOCAB + """, x AS (SELECT c.sid, c.i, lower(c.tok) AS lower, coalesce(b.role, 'NONE') AS role, left(c.tok, 3) AS prefix3 FROM clean c LEFT JOIN best b ON c.w = b.word)
SELECT sid, i::BIGINT AS i, lower, role, prefix3, i = 0 AS bos, coalesce(lag(role) OVER z, 'BOS') AS role_m1, coalesce(lead(lower, 2) OVER z, 'EOS') AS lower_p2 FROM x WINDOW z AS (PARTITION BY sid ORDER BY i)""")
def p19(spark, sf):
    t = tokens(spark, sf).drop("role").withColumn("postag", F.lit("UNK"))
    x = features.feature_table(t, features.best_role(vocab(spark, sf)), postag=False)
    return x.select("sid", *long("i"), "lower", "role", "prefix3", "bos", "role_m1", "lower_p2")


HEAD = "CASE WHEN i % 7 = 0 THEN NULL ELSE i - (i % 3) - 1 END"


@query("j9_parent_child", f"WITH h AS (SELECT sid, i, {HEAD} AS head FROM tok) SELECT p.sid, p.i::BIGINT AS i, count(*)::BIGINT AS children, min(c.i)::BIGINT AS first_child FROM h p JOIN h c ON p.sid = c.sid AND c.head = p.i GROUP BY p.sid, p.i")
def j9(spark, sf):
    h = tokens(spark, sf).select("sid", "i", F.when(F.col("i") % 7 != 0, F.col("i") - F.col("i") % 3 - 1).alias("head"))
    kids = h.where("head is not null").select("sid", F.col("head").alias("i"), F.col("i").alias("child"))
    return h.select("sid", "i").join(kids, ["sid", "i"]).groupBy("sid", "i").agg(F.count(F.lit(1)).alias("children"), F.min("child").cast("bigint").alias("first_child")).withColumn("i", F.col("i").cast("bigint"))


#: From normalised words nt(sid, i, w): n-grams, and the candidates of the lexicon's phrases.
GRAMS = """,
g AS (SELECT sid, i, 1 AS size, w AS key FROM nt UNION ALL SELECT * FROM (SELECT sid, i, 2, w || ' ' || lead(w) OVER (PARTITION BY sid ORDER BY i) FROM nt) WHERE 1 = 1),
lk AS (SELECT ord, id, role, pattern AS key, len(string_split(pattern, ' ')) AS size FROM lex WHERE match_type IN ('phrase', 'exact', 'lemma')),
cand AS (SELECT g.sid, g.i AS s, g.i + g.size AS e, lk.role, lk.id, lk.ord FROM g JOIN lk USING (size, key) WHERE g.key IS NOT NULL)"""
NGRAMS = f"WITH nt AS (SELECT sid, i, {NORMAL.format(t='tok')} AS w FROM tok)" + GRAMS


@query("j10_ngram_join", NGRAMS + " SELECT sid, s::BIGINT AS s, e::BIGINT AS e, role, id FROM cand")
def j10(spark, sf):
    return lexicon.candidates(tokens(spark, sf).select("sid", "i", "tok"), lex(spark), LONGEST).select("sid", *long("s", "e"), "role", "id")


@query("j11_band_join", "WITH a AS (SELECT sid, i FROM flag WHERE math), v AS (SELECT sid, i FROM clean WHERE length(w) <= 2) SELECT v.sid, v.i::BIGINT AS i FROM v WHERE EXISTS (SELECT 1 FROM a WHERE a.sid = v.sid AND abs(a.i - v.i) <= 3)")
def j11(spark, sf):
    f = flagged(spark, sf)
    return lexicon.near_anchor(f.where(F.length("w") <= 2).select("sid", "i"), f.where("math").select("sid", "i")).select("sid", *long("i"))


OTHER = r"WITH ot AS (SELECT sid, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS ps FROM sent), other AS (SELECT sid, unnest(range(len(ps)))::INT AS i, unnest(ps) AS tok FROM ot)"
CHARS = r"""c1 AS (SELECT sid, i, ch, row_number() OVER (PARTITION BY sid ORDER BY i, k) AS pos FROM (SELECT sid, i, unnest(range(len(x))) AS k, unnest(x) AS ch FROM (SELECT sid, i, regexp_extract_all(lower(tok), '[\p{L}\p{N}]') AS x FROM tok))),
c2 AS (SELECT sid, i AS j, ch, row_number() OVER (PARTITION BY sid ORDER BY i, k) AS pos FROM (SELECT sid, i, unnest(range(len(x))) AS k, unnest(x) AS ch FROM (SELECT sid, i, regexp_extract_all(lower(tok), '[\p{L}\p{N}]') AS x FROM other))),
vote AS (SELECT sid, i, j, count(*) AS n, min(pos) AS fst FROM c1 JOIN c2 USING (sid, pos, ch) GROUP BY sid, i, j),
bst AS (SELECT sid, i, arg_min(j, (-n, fst)) AS j FROM vote GROUP BY sid, i)"""


def other(spark, sf):
    return sentences(spark, sf).select("sid", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("i", "tok"))


@query("j12_char_alignment", OTHER + ", " + CHARS + " SELECT t.sid, t.i::BIGINT AS i, b.j::BIGINT AS j FROM tok t LEFT JOIN bst b USING (sid, i)")
def j12(spark, sf):
    return align.char_votes(tokens(spark, sf), other(spark, sf)).select("sid", *long("i", "j"))


@query("a9_majority_vote", OTHER + ", " + CHARS + " SELECT sid, i::BIGINT AS i, j::BIGINT AS j FROM bst")
def a9(spark, sf):
    return align.char_votes(tokens(spark, sf), other(spark, sf)).where("j is not null").select("sid", *long("i", "j"))


@query("j13_fast_path_or_alignment", OTHER + ", " + CHARS + """, n1 AS (SELECT sid, count(*) AS n FROM tok GROUP BY sid), n2 AS (SELECT sid, count(*) AS n FROM other GROUP BY sid), same AS (SELECT sid FROM n1 JOIN n2 USING (sid, n))
SELECT t.sid, t.i::BIGINT AS i, (CASE WHEN s.sid IS NOT NULL THEN t.i ELSE b.j END)::BIGINT AS j, CASE WHEN s.sid IS NOT NULL THEN 'place' WHEN b.j IS NULL THEN 'none' ELSE 'characters' END AS how FROM tok t LEFT JOIN same s USING (sid) LEFT JOIN bst b ON t.sid = b.sid AND t.i = b.i""")
def j13(spark, sf):
    return align.align_tokens(tokens(spark, sf), other(spark, sf)).select("sid", *long("i", "j"), "how")


PAIRS = """WITH g AS (SELECT DISTINCT sid, s, e FROM span2 WHERE sid IN (SELECT sid FROM pred)), p AS (SELECT DISTINCT sid, s, e FROM span0 WHERE sid % 7 <> 3)"""
SCORE = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"


@query("j14_span_difference", PAIRS + " SELECT sid, s::BIGINT AS s, e::BIGINT AS e, 'FN' AS kind FROM (SELECT sid, s, e FROM span2 EXCEPT SELECT sid, s, e FROM p) UNION ALL SELECT sid, s, e, 'FP' FROM (SELECT sid, s, e FROM p EXCEPT SELECT sid, s, e FROM span2)")
def j14(spark, sf):
    return evaluate.span_errors(gold(spark, sf), pred(spark, sf)).select("sid", *long("s", "e"), "kind")


@query("j15_tokens_in_spans", "SELECT t.sid, s.s::BIGINT AS s, t.i::BIGINT AS i, t.tok FROM tok t JOIN span2 s ON t.sid = s.sid AND t.i >= s.s AND t.i < s.e")
def j15(spark, sf):
    f = flagged(spark, sf)
    inside = bio.gap_spans(f, 2).select("sid", "s", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i"))
    return f.join(inside, ["sid", "i"]).select("sid", *long("s", "i"), "tok")


@query("a1_split_profile", f"WITH x AS (SELECT *, {SPLIT3} AS split FROM bio2) SELECT coalesce(split, 'TOTAL') AS split, count(DISTINCT sid)::BIGINT AS sentences, count(*)::BIGINT AS tokens, count(*) FILTER (tag <> 'O')::BIGINT AS math_tokens, count(*) FILTER (tag = 'B-MATH')::BIGINT AS spans FROM x GROUP BY ROLLUP (split)")
def a1(spark, sf):
    return corpus.profile(gold(spark, sf).withColumn("split", split3()))


@query("a2_converter_profile", "SELECT count(DISTINCT sid)::BIGINT AS sentences, count(*)::BIGINT AS tokens, count(*) FILTER (tag <> 'O')::BIGINT AS math_tokens, count(*) FILTER (tag = 'B-MATH')::BIGINT AS spans, count(DISTINCT CASE WHEN tag = 'B-MATH' THEN sid END)::BIGINT AS with_math FROM bio2")
def a2(spark, sf):
    b = F.col("tag") == bio.B
    return gold(spark, sf).agg(F.countDistinct("sid").alias("sentences"), F.count(F.lit(1)).alias("tokens"), F.count_if(F.col("tag") != bio.O).alias("math_tokens"), F.count_if(b).alias("spans"), F.countDistinct(F.when(b, F.col("sid"))).alias("with_math"))


@query("a3_tag_histogram", "SELECT tag, count(*)::BIGINT AS n FROM bio2 GROUP BY tag")
def a3(spark, sf):
    return gold(spark, sf).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("a4_span_length_histogram", "SELECT (e - s)::BIGINT AS length, count(*)::BIGINT AS n FROM span2 GROUP BY 1")
def a4(spark, sf):
    return corpus.span_lengths(gold(spark, sf)).groupBy("length").agg(F.count(F.lit(1)).alias("n"))


@query("a5_spans_per_sentence", "SELECT n_spans, count(*)::BIGINT AS sentences FROM (SELECT sid, count(*) FILTER (tag = 'B-MATH')::BIGINT AS n_spans FROM bio2 GROUP BY sid) GROUP BY n_spans")
def a5(spark, sf):
    return corpus.spans_per_sentence(gold(spark, sf))


@query("a10_span_f1_pooled", PAIRS + f", gp AS (SELECT DISTINCT s, e FROM g), pp AS (SELECT DISTINCT s, e FROM p), n AS (SELECT (SELECT count(*) FROM (SELECT * FROM gp INTERSECT SELECT * FROM pp)) AS tp, (SELECT count(*) FROM (SELECT * FROM pp EXCEPT SELECT * FROM gp)) AS fp, (SELECT count(*) FROM (SELECT * FROM gp EXCEPT SELECT * FROM pp)) AS fn) SELECT {SCORE} FROM n")
def a10(spark, sf):
    return evaluate.span_scores(gold(spark, sf), pred(spark, sf), pooled=True)


@query("a13_span_f1_keyed", PAIRS + f", n AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM g)) AS fp, (SELECT count(*) FROM (SELECT * FROM g EXCEPT SELECT * FROM p)) AS fn) SELECT {SCORE} FROM n")
def a13(spark, sf):
    return evaluate.span_scores(gold(spark, sf), pred(spark, sf))


@query("a11_token_f1", f"WITH n AS (SELECT count(*) FILTER (g.tag <> 'O' AND p.tag <> 'O') AS tp, count(*) FILTER (g.tag = 'O' AND p.tag <> 'O') AS fp, count(*) FILTER (g.tag <> 'O' AND p.tag = 'O') AS fn, count(*) FILTER (g.tag = 'O' AND p.tag = 'O')::BIGINT AS tn FROM bio2 g JOIN pred p USING (sid, i)) SELECT {SCORE}, tn FROM n")
def a11(spark, sf):
    return evaluate.token_scores(gold(spark, sf), pred(spark, sf))


EXACT = "SELECT count(*)::BIGINT AS n, count(*) FILTER (same)::BIGINT AS n_exact, round(count(*) FILTER (same) / count(*)::DOUBLE, 6) AS exact_match FROM"


@query("a12_exact_match_spans", PAIRS + f", ids AS (SELECT DISTINCT sid FROM pred), bad AS ((SELECT * FROM g EXCEPT SELECT * FROM p) UNION (SELECT * FROM p EXCEPT SELECT * FROM g)) {EXACT} (SELECT sid NOT IN (SELECT sid FROM bad) AS same FROM ids)")
def a12(spark, sf):
    return evaluate.exact_match(gold(spark, sf), pred(spark, sf))


@query("a12_exact_match_tags", f"{EXACT} (SELECT bool_and(g.tag = p.tag) AS same FROM bio2 g JOIN pred p USING (sid, i) GROUP BY g.sid)")
def a12_tags(spark, sf):
    return evaluate.exact_match(gold(spark, sf), pred(spark, sf), by_tags=True)


@query("a14_sequence_assembly", "SELECT sid, string_agg(tok, ' ' ORDER BY i) AS tokens, string_agg(CASE tag WHEN 'O' THEN '0' WHEN 'B-MATH' THEN '1' ELSE '2' END, '' ORDER BY i) AS labels FROM bio2 GROUP BY sid")
def a14(spark, sf):
    x = bio.assemble(gold(spark, sf).withColumn("code", bio.encode(F.col("tag")).cast("string")), "tok", "code")
    return x.select("sid", F.array_join("tok", " ").alias("tokens"), F.array_join("code", "").alias("labels"))


@query("a15_error_roles", VOCAB + """, e AS (SELECT sid, s, e, 'FN' AS kind FROM (SELECT sid, s, e FROM span2 EXCEPT SELECT sid, s, e FROM span0 WHERE sid % 7 <> 3) UNION ALL SELECT sid, s, e, 'FP' FROM (SELECT sid, s, e FROM span0 WHERE sid % 7 <> 3 EXCEPT SELECT sid, s, e FROM span2))
SELECT e.kind, coalesce(b.role, 'no_role') AS role, count(*)::BIGINT AS n FROM e JOIN clean c ON c.sid = e.sid AND c.i >= e.s AND c.i < e.e LEFT JOIN best b ON c.w = b.word GROUP BY 1, 2""")
def a15(spark, sf):
    roles = features.with_role(tokens(spark, sf).drop("role"), features.best_role(vocab(spark, sf))).where("is_math").select("sid", "i", "role")
    return evaluate.error_roles(gold(spark, sf), pred(spark, sf), roles)


@query("a16_value_distribution", SIDE_SQL + " SELECT coalesce(nullif(trim(s.dep), ''), 'UNK') AS dep, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM tok)::DOUBLE, 6) AS share FROM tok t LEFT JOIN side s USING (sid, i) GROUP BY 1")
def a16(spark, sf):
    n = j5(spark, sf).groupBy("dep").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("all")))).select("dep", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("a17_mean_population_std", "SELECT lang AS config, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT lang, source, avg(n_chars) AS x FROM documents GROUP BY lang, source) GROUP BY lang")
def a17(spark, sf):
    runs = table(spark, sf, "documents").groupBy(F.col("lang").alias("config"), "source").agg(F.avg("n_chars").alias("value"))
    return evaluate.over_seeds(runs)


@query("a18_span_length_stats", "SELECT min(e - s)::BIGINT AS lo, max(e - s)::BIGINT AS hi, round(avg(e - s), 6) AS mean, median(e - s)::DOUBLE AS median FROM span2")
def a18(spark, sf):
    return corpus.span_lengths(gold(spark, sf)).agg(F.min("length").alias("lo"), F.max("length").alias("hi"), F.round(F.avg("length"), 6).alias("mean"), F.median("length").alias("median"))


@query("a19_coverage", SIDE_SQL + f" SELECT {SPLIT3} AS split, count(*)::BIGINT AS total, count(s.sid)::BIGINT AS hits, round(count(s.sid) / count(*)::DOUBLE, 6) AS ratio FROM tok t LEFT JOIN side s USING (sid, i) GROUP BY 1")
def a19(spark, sf):
    return features.coverage(tokens(spark, sf), side(spark, sf), split3())


@query("a20_group_nunique", "SELECT lang, count(DISTINCT source)::BIGINT AS sources, count(DISTINCT doc_id)::BIGINT AS docs FROM documents GROUP BY lang")
def a20(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources"), F.countDistinct("doc_id").alias("docs"))


METRICS = "WITH m AS (SELECT lang AS config, row_number() OVER (ORDER BY lang) AS ord, round(avg(n_chars), 6) AS value FROM documents GROUP BY lang)"


def metrics(spark, sf):
    m = table(spark, sf, "documents").groupBy(F.col("lang").alias("config")).agg(F.round(F.avg("n_chars"), 6).alias("value"))
    return m.withColumn("ord", F.row_number().over(Window.orderBy("config")))


@query("a21_argmax_row", METRICS + " SELECT arg_max(config, (value, -ord)) AS config, max(value) AS value FROM m")
def a21(spark, sf):
    return models.best_config(metrics(spark, sf))


@query("a22_delta_to_baseline", METRICS + " SELECT config, round(value - first_value(value) OVER (ORDER BY ord), 6) AS delta FROM m")
def a22(spark, sf):
    return metrics(spark, sf).select("config", F.round(F.col("value") - F.first("value").over(Window.orderBy("ord")), 6).alias("delta"))


@query("a23_distinct_slot_counts", "SELECT string_agg(DISTINCT n::VARCHAR, ',' ORDER BY n::VARCHAR) AS counts FROM (SELECT count(*) AS n FROM span2 GROUP BY sid)")
def a23(spark, sf):
    n = bio.gap_spans(flagged(spark, sf), 2).groupBy("sid").agg(F.count(F.lit(1)).cast("string").alias("n"))
    return n.agg(F.array_join(F.array_sort(F.collect_set("n")), ",").alias("counts"))


@query("a24_reconciliation", f"""WITH a AS (SELECT {SPLIT3} AS split, count(DISTINCT sid)::BIGINT AS n FROM bio2 GROUP BY 1), x(split, n) AS (VALUES ('test', 50::BIGINT), ('val', 30::BIGINT), ('train_llm', 510::BIGINT))
SELECT split, x.n AS expected, a.n AS actual, CASE WHEN x.n IS NULL THEN 'unexpected' WHEN a.n IS NULL THEN 'missing' WHEN x.n = a.n THEN 'ok' ELSE 'differs' END AS status FROM x FULL JOIN a USING (split)""")
def a24(spark, sf):
    actual = gold(spark, sf).groupBy(split3().alias("split")).agg(F.countDistinct("sid").alias("n"))
    return corpus.reconcile(actual, spark.createDataFrame([("test", 50), ("val", 30), ("train_llm", 510)], "split string, n bigint"), "split", "n")


WEIGHTS = "WITH n AS (SELECT w AS attr, count(*) FILTER (tag = 'B-MATH') AS b, count(*) FILTER (tag = 'I-MATH') AS i, count(*) AS al FROM bio2 GROUP BY w), wt AS (SELECT attr, 'B-MATH' AS tag, round(ln((b + 1) / (al - b + 1)::DOUBLE), 6) AS weight FROM n UNION ALL SELECT attr, 'I-MATH', round(ln((i + 1) / (al - i + 1)::DOUBLE), 6) FROM n)"


@query("a26_attribute_weights", WEIGHTS + " SELECT * FROM wt")
def a26(spark, sf):
    return models.attribute_weights(gold(spark, sf), F.col("w"))


@query("t2_top_weights", WEIGHTS + " SELECT * FROM wt ORDER BY weight DESC, attr, tag LIMIT 20")
def t2(spark, sf):
    return a26(spark, sf).orderBy(F.desc("weight"), "attr", "tag").limit(20)


@query("report_evaluation", PAIRS + """, n AS (SELECT (SELECT count(*) FROM (SELECT * FROM g INTERSECT SELECT * FROM p)) AS tp, (SELECT count(*) FROM g) AS ng, (SELECT count(*) FROM p) AS np),
ids AS (SELECT DISTINCT sid FROM pred), bad AS ((SELECT * FROM g EXCEPT SELECT * FROM p) UNION (SELECT * FROM p EXCEPT SELECT * FROM g)),
t AS (SELECT count(*) AS n, 2 * count(*) FILTER (g.tag <> 'O' AND p.tag <> 'O') AS tp2, count(*) FILTER (g.tag <> 'O') + count(*) FILTER (p.tag <> 'O') AS ngp FROM bio2 g JOIN pred p USING (sid, i))
SELECT (SELECT count(*) FROM ids)::BIGINT AS n_sentences, 0::BIGINT AS length_mismatches, t.n::BIGINT AS n_tokens, round(2 * tp / (ng + np)::DOUBLE, 6) AS span_f1, round(tp2 / ngp::DOUBLE, 6) AS token_f1, (SELECT round(count(*) FILTER (sid NOT IN (SELECT sid FROM bad)) / count(*)::DOUBLE, 6) FROM ids) AS exact_match FROM n, t""")
def report(spark, sf):
    return evaluate.report(gold(spark, sf), pred(spark, sf))


@query("p14_spoken_variable_filter", NGRAMS + f", up AS (SELECT sid, i, {UPOS} AS upos FROM tok) SELECT sid, s::BIGINT AS s, e::BIGINT AS e, id FROM cand c WHERE NOT (role = 'VARIABLE' AND EXISTS (SELECT 1 FROM up WHERE up.sid = c.sid AND up.i >= c.s AND up.i < c.e AND upos IN ('ADP', 'CCONJ', 'SCONJ', 'PART', 'PRON')))")
def p14(spark, sf):
    t = tokens(spark, sf)
    found = lexicon.candidates(t.select("sid", "i", "tok"), lex(spark), LONGEST)
    return lexicon.drop_spoken_variables(found, with_upos(t)).select("sid", *long("s", "e"), "id")


@query("p15_role_partition", NGRAMS + " SELECT role IN ('NEGATIVE_CONTEXT', 'BOUNDARY', 'BOUNDARY_AMBIGUOUS', 'END_CONTEXT', 'DISCOURSE_START') AS boundary, role, count(*)::BIGINT AS n FROM cand GROUP BY 1, 2")
def p15(spark, sf):
    return j10(spark, sf).groupBy(F.col("role").isin(*lexicon.BOUNDARY_ROLES).alias("boundary"), "role").agg(F.count(F.lit(1)).alias("n"))


@query("t6_match_order", NGRAMS + " SELECT sid, s::BIGINT AS s, e::BIGINT AS e, id, (row_number() OVER (PARTITION BY sid ORDER BY s, s - e, id))::BIGINT AS place FROM cand")
def t6(spark, sf):
    order = Window.partitionBy("sid").orderBy("s", F.col("s") - F.col("e"), "id")
    return j10(spark, sf).select("sid", "s", "e", "id", F.row_number().over(order).cast("bigint").alias("place"))


@query("t5_longest_first", NGRAMS + " SELECT sid, s::BIGINT AS s, id, (row_number() OVER (PARTITION BY sid ORDER BY s - e, ord, s))::BIGINT AS place FROM cand")
def t5(spark, sf):
    found = lexicon.candidates(tokens(spark, sf).select("sid", "i", "tok"), lex(spark), LONGEST)
    order = Window.partitionBy("sid").orderBy(F.col("s") - F.col("e"), "ord", "s")
    return found.select("sid", *long("s"), "id", F.row_number().over(order).cast("bigint").alias("place"))
