"""Queries over tag sequences: windows (W), set operations (U), sorts (T), and the flagship."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio, corpus, evaluate, lexicon, models
from spanspark.plans.registry import lexicon as lex
from spanspark.plans.registry import RUN, flagged, gold, long, pred, pred_all, query, raw_tags, sentences, tokens


@query("entry_span_lengths", "SELECT t.role, (s.e - s.s)::BIGINT AS length, count(*)::BIGINT AS n FROM span2 s JOIN (SELECT sid, role FROM sent) t USING (sid) GROUP BY ALL")
def entry_span_lengths(spark, sf):
    """Tokens, lexicon flags, gap merge, tags, strict spans, histogram by role."""
    tags = gold(spark, sf)
    roles = sentences(spark, sf).select("sid", "role")
    return corpus.span_lengths(tags).join(roles, "sid").groupBy("role", "length").agg(F.count(F.lit(1)).alias("n"))


BIT = "((sid * 13 + i * 7) % 5 < 2)::INT"


@query("w1_mask_to_bio", f"SELECT sid, i::BIGINT AS i, CASE WHEN b = 0 THEN 'O' WHEN coalesce(lag(b) OVER (PARTITION BY sid ORDER BY i), 0) = 0 THEN 'B-MATH' ELSE 'I-MATH' END AS tag FROM (SELECT *, {BIT} AS b FROM tok)")
def w1(spark, sf):
    bits = tokens(spark, sf).withColumn("bit", ((F.col("sid") * 13 + F.col("i") * 7) % 5 < 2).cast("int"))
    return bio.mask_to_bio(bits).select("sid", *long("i"), "tag")


@query("w2_gap_merge", "SELECT sid, s::BIGINT AS s, e::BIGINT AS e FROM span2")
def w2(spark, sf):
    return bio.gap_spans(flagged(spark, sf), 2).select("sid", *long("s", "e"))


@query("w2_gap_merge_tags", "SELECT sid, i::BIGINT AS i, tok, tag FROM bio2")
def w2_tags(spark, sf):
    return gold(spark, sf).select("sid", *long("i"), "tok", "tag")


STRICT = f"""WITH k AS (SELECT *, sum((tag <> 'I-MATH')::INT) OVER ({RUN} CURRENT ROW) AS k FROM {{src}})
SELECT sid, min(i)::BIGINT AS s, (max(i) + 1)::BIGINT AS e FROM k WHERE tag <> 'O' GROUP BY sid, k HAVING arg_min(tag, i) = 'B-MATH'"""


@query("w3a_spans_strict", STRICT.format(src="raw"))
def w3a(spark, sf):
    return bio.spans(raw_tags(spark, sf)).select("sid", *long("s", "e"))


@query("w3b_spans_lenient", f"""WITH st AS (SELECT *, coalesce(tag = 'B-MATH' OR (tag = 'I-MATH' AND coalesce(lag(tag) OVER (PARTITION BY sid ORDER BY i), 'O') = 'O'), false) AS st FROM raw),
k AS (SELECT *, sum((st OR tag = 'O')::INT) OVER ({RUN} CURRENT ROW) AS k FROM st)
SELECT sid, min(i)::BIGINT AS s, (max(i) + 1)::BIGINT AS e FROM k WHERE tag <> 'O' GROUP BY sid, k HAVING arg_min(st, i)""")
def w3b(spark, sf):
    return bio.spans(raw_tags(spark, sf), lenient=True).select("sid", *long("s", "e"))


BAD = "SELECT sid, i::BIGINT AS i FROM (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY i) AS b FROM raw) WHERE tag = 'I-MATH' AND coalesce(b, '{start}') = 'O'"


@query("w4_bio_violations", BAD.format(start="O"))
def w4(spark, sf):
    return bio.violations(raw_tags(spark, sf)).select("sid", *long("i"))


@query("w4_bio_violations_soft", BAD.format(start="B"))
def w4_soft(spark, sf):
    return bio.violations(raw_tags(spark, sf), at_start=False).select("sid", *long("i"))


SPLIT_MARKS = r"""WITH parts AS (SELECT sid, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS ps FROM sent),
each AS (SELECT sid, (unnest(range(len(ps))))::INT AS i, unnest(ps) AS tok FROM parts),
tagged AS (SELECT *, CASE WHEN (sid * 31 + i * 17) % 11 < 4 THEN 'O' WHEN (sid * 31 + i * 17) % 11 < 8 THEN 'I-MATH' ELSE 'B-MATH' END AS tag FROM each)"""


@query("w5_punct_outside", SPLIT_MARKS + f""",
p AS (SELECT *, regexp_matches(tok, '^[.,;!?]+$') AS p FROM tagged),
np AS (SELECT *, coalesce(sum((NOT p)::INT) OVER ({RUN} 1 PRECEDING), 0) AS np FROM p),
l AS (SELECT *, coalesce(bool_or(p AND tag <> 'O') OVER (PARTITION BY sid, np ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS lost FROM np)
SELECT sid, i::BIGINT AS i, tok, CASE WHEN p THEN 'O' WHEN tag = 'I-MATH' AND lost THEN 'B-MATH' ELSE tag END AS tag FROM l""")
def w5(spark, sf):
    return bio.punct_outside(marked(spark, sf)).select("sid", *long("i"), "tok", "tag")


def marked(spark, sf):
    """Words and marks as tokens of their own, with arithmetic tags."""
    r = (F.col("sid") * 31 + F.col("i") * 17) % 11
    each = sentences(spark, sf).select("sid", F.posexplode(T.words_and_marks(F.col("text"))).alias("i", "tok"))
    return each.withColumn("tag", F.when(r < 4, "O").when(r < 8, "I-MATH").otherwise("B-MATH"))


@query("w6_context_window", """SELECT sid, i::BIGINT AS i, coalesce(lag(w, 1) OVER z, 'BOS') AS w_m1, coalesce(lag(w, 2) OVER z, 'BOS') AS w_m2, coalesce(lead(w, 1) OVER z, 'EOS') AS w_p1, coalesce(lead(w, 2) OVER z, 'EOS') AS w_p2,
coalesce(lag(math, 1) OVER z, false) AS math_m1, coalesce(lag(math, 2) OVER z, false) AS math_m2, coalesce(lead(math, 1) OVER z, false) AS math_p1, coalesce(lead(math, 2) OVER z, false) AS math_p2 FROM flag WINDOW z AS (PARTITION BY sid ORDER BY i)""")
def w6(spark, sf):
    return bio.context(flagged(spark, sf).select("sid", "i", "w", "math"), ("w", "math")).drop("w", "math").withColumn("i", F.col("i").cast("bigint"))


@query("w7_bos_eos", "SELECT sid, i::BIGINT AS i, i = 0 AS bos, i = max(i) OVER (PARTITION BY sid) AS eos FROM tok")
def w7(spark, sf):
    return bio.edges(tokens(spark, sf)).select("sid", *long("i"), "bos", "eos")


@query("w10_ids_over_input", "SELECT sid, 'syn_' || printf('%04d', row_number() OVER (ORDER BY sid) - 1) AS id FROM sent QUALIFY sid % 3 <> 0")
def w10_input(spark, sf):
    return corpus.numbered(sentences(spark, sf).select("sid"), "syn", "sid").where("sid % 3 <> 0")


@query("w10_ids_over_kept", "SELECT sid, 'llm_' || printf('%04d', row_number() OVER (ORDER BY sid) - 1) AS id FROM sent WHERE sid % 3 <> 0")
def w10_kept(spark, sf):
    return corpus.numbered(sentences(spark, sf).select("sid"), "llm", "sid", F.col("sid") % 3 != 0)


SENT_NO = "coalesce(sum(regexp_matches(tok, '[.!?;]')::INT) OVER (" + RUN + " 1 PRECEDING), 0)"


@query("w11_reindex_by_sentence", f"WITH n AS (SELECT *, {SENT_NO} AS sent_no FROM tok) SELECT sid, i::BIGINT AS i, sent_no::BIGINT AS sent_no, (row_number() OVER (PARTITION BY sid, sent_no ORDER BY i) - 1)::BIGINT AS j FROM n")
def w11(spark, sf):
    x = tokens(spark, sf).withColumn("sent_no", F.coalesce(F.sum(F.col("tok").rlike(T.SENTENCE_BREAK).cast("int")).over(bio.before()), F.lit(0)))
    return x.withColumn("j", F.row_number().over(Window.partitionBy("sid", "sent_no").orderBy("i")) - 1).select("sid", *long("i", "sent_no", "j"))


@query("w12_mask_index", SPLIT_MARKS + f" SELECT sid, i::BIGINT AS i, CASE WHEN NOT p THEN (sum((NOT p)::INT) OVER ({RUN} CURRENT ROW) - 1)::BIGINT END AS mask_index FROM (SELECT *, regexp_matches(tok, '^[.,;!?]+$') AS p FROM tagged)")
def w12(spark, sf):
    x = marked(spark, sf).withColumn("p", F.col("tok").rlike(T.PUNCT_OUTSIDE))
    return x.select("sid", *long("i"), F.when(~F.col("p"), F.sum((~F.col("p")).cast("int")).over(bio.to_here()) - 1).cast("bigint").alias("mask_index"))


NORMAL = r"translate(replace(lower(trim({t})), 'ё', 'е'), '!\"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~«»„“”…—–', '')".replace('\\"', '"')


@query("w13_previous_word", f"SELECT s.sid, s.s::BIGINT AS s, {NORMAL.format(t='t.tok')} AS prev FROM span2 s LEFT JOIN tok t ON s.sid = t.sid AND t.i = s.s - 1")
def w13(spark, sf):
    return lexicon.previous_word(bio.gap_spans(flagged(spark, sf), 2), tokens(spark, sf)).select("sid", *long("s"), "prev")


STRONG = r"'[.?!;:]\s*$'"


@query("w14_prefix_until_break", f"""WITH kept AS (SELECT sid, i, i // 12 AS span FROM tok WHERE (sid + i * 3) % 4 <> 1),
c AS (SELECT sid, i, sum(regexp_matches(tok, {STRONG})::INT) OVER ({RUN} CURRENT ROW) - regexp_matches(tok, {STRONG})::INT AS before, regexp_matches(tok, {STRONG})::INT AS own FROM tok),
k AS (SELECT k.*, c.before, first_value(c.before) OVER (PARTITION BY k.sid, k.span ORDER BY k.i) AS b0 FROM kept k JOIN c USING (sid, i))
SELECT sid, span::BIGINT AS span, i::BIGINT AS i FROM k WHERE before = b0""")
def w14(spark, sf):
    t = tokens(spark, sf)
    kept = t.where((F.col("sid") + F.col("i") * 3) % 4 != 1).select("sid", "i", (F.col("i") / 12).cast("int").alias("span"))
    return lexicon.prefix_until_break(kept, t).select("sid", *long("span", "i"))


UPOS = "CASE (sid + i) % 5 WHEN 0 THEN 'ADP' WHEN 1 THEN 'PART' WHEN 2 THEN 'NOUN' WHEN 3 THEN 'VERB' ELSE 'SCONJ' END"


def with_upos(t):
    r = (F.col("sid") + F.col("i")) % 5
    return t.withColumn("upos", F.when(r == 0, "ADP").when(r == 1, "PART").when(r == 2, "NOUN").when(r == 3, "VERB").otherwise("SCONJ"))


@query("w15_trim_leading", f"""WITH k AS (SELECT sid, i // 5 AS span, i, {UPOS} AS upos, math AS anchor FROM flag),
f AS (SELECT *, coalesce(min(CASE WHEN anchor OR upos NOT IN ('ADP', 'SCONJ', 'PART', 'CCONJ') THEN i END) OVER (PARTITION BY sid, span), max(i) OVER (PARTITION BY sid, span)) AS fst FROM k)
SELECT sid, span::BIGINT AS span, i::BIGINT AS i FROM f WHERE i >= fst""")
def w15(spark, sf):
    kept = with_upos(flagged(spark, sf)).select("sid", (F.col("i") / 5).cast("int").alias("span"), "i", "upos", F.col("math").alias("anchor"))
    return lexicon.trim_leading(kept).select("sid", *long("span", "i"))


@query("w16_first_appearance", "SELECT role, w, min(sid * 10000 + i)::BIGINT AS first_row, row_number() OVER (PARTITION BY role ORDER BY min(sid * 10000 + i))::BIGINT AS place FROM clean GROUP BY role, w")
def w16(spark, sf):
    first = flagged(spark, sf).groupBy("role", "w").agg(F.min(F.col("sid") * 10000 + F.col("i")).alias("first_row"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("role").orderBy("first_row")).cast("bigint"))


LOG = "SELECT conv_id AS run, turn AS epoch, round(length(text) / 1000.0, 6) AS value FROM sent"


@query("w17_early_stopping", f"""WITH g AS (SELECT *, coalesce(value > max(value) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS gain FROM ({LOG})),
b AS (SELECT *, last_value(CASE WHEN gain THEN epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM g),
s AS (SELECT run, coalesce(min(CASE WHEN epoch - best >= 2 THEN epoch END), max(epoch)) AS stop_epoch FROM b GROUP BY run)
SELECT run, max(best)::BIGINT AS best_epoch, max(stop_epoch)::BIGINT AS stop_epoch FROM b JOIN s USING (run) WHERE epoch <= stop_epoch GROUP BY run""")
def w17(spark, sf):
    log = sentences(spark, sf).select(F.col("conv_id").alias("run"), F.col("turn").alias("epoch"), F.round(F.length("text") / 1000.0, 6).alias("value"))
    return models.early_stop(log, 2).select("run", *long("best_epoch", "stop_epoch"))


@query("h11_spans_to_bio", "SELECT sid, i::BIGINT AS i, tag FROM bio2")
def h11(spark, sf):
    t = flagged(spark, sf)
    return bio.paint(bio.gap_spans(t, 2), t).select("sid", *long("i"), "tag")


@query("u1_union_sources", "SELECT sid, i::BIGINT AS i, tok, tag, 'gap2' AS source, 'train_clean' AS split FROM bio2 UNION ALL SELECT sid, i, tok, tag, 'gap0', 'train_noisy' FROM bio0 UNION ALL SELECT sid, i, tok, tag, 'raw', 'train_llm' FROM raw")
def u1(spark, sf):
    return corpus.merged({"gap2": (gold(spark, sf), "train_clean"), "gap0": (pred_all(spark, sf), "train_noisy"), "raw": (raw_tags(spark, sf), "train_llm")}).withColumn("i", F.col("i").cast("bigint"))


@query("u2_concat_splits", "SELECT sid, i::BIGINT AS i, tag, 'train_clean' AS split FROM bio2 UNION ALL SELECT sid, i, tag, 'train_llm' FROM raw")
def u2(spark, sf):
    whole = corpus.merged({"gap2": (gold(spark, sf), "train_clean"), "gap0": (pred_all(spark, sf), "train_noisy"), "raw": (raw_tags(spark, sf), "train_llm")})
    return whole.where(F.col("split").isin("train_clean", "train_llm")).select("sid", *long("i"), "tag", "split")


@query("u3_intersect_spans", "SELECT sid, s::BIGINT AS s, e::BIGINT AS e FROM span2 INTERSECT SELECT sid, s, e FROM span0")
def u3(spark, sf):
    f = flagged(spark, sf)
    return bio.gap_spans(f, 2).intersect(bio.gap_spans(f, 0)).select("sid", *long("s", "e"))


@query("u4_except_spans", "SELECT sid, s::BIGINT AS s, e::BIGINT AS e FROM span2 EXCEPT SELECT sid, s, e FROM span0")
def u4(spark, sf):
    f = flagged(spark, sf)
    return bio.gap_spans(f, 2).subtract(bio.gap_spans(f, 0)).select("sid", *long("s", "e"))


@query("u5_distinct_ids", "SELECT DISTINCT sid FROM flag WHERE math")
def u5(spark, sf):
    return flagged(spark, sf).where("math").select("sid").distinct()


@query("u6_dropped_sentences", "SELECT DISTINCT sid FROM bio2 WHERE sid NOT IN (SELECT sid FROM pred) UNION SELECT DISTINCT sid FROM pred WHERE sid NOT IN (SELECT sid FROM bio2)")
def u6(spark, sf):
    from spanspark.sources.sinks import dropped_sentences

    return dropped_sentences(gold(spark, sf), pred(spark, sf))


@query("t1_sorted_tokens", "SELECT sid, string_agg(tok, ' ' ORDER BY i) AS line FROM tok GROUP BY sid")
def t1(spark, sf):
    return bio.assemble(tokens(spark, sf), "tok").select("sid", F.array_join("tok", " ").alias("line"))


@query("t3_first_error_sentences", "SELECT DISTINCT sid FROM (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY i) AS b FROM raw) WHERE tag = 'I-MATH' AND coalesce(b, 'O') = 'O' ORDER BY sid LIMIT 10")
def t3(spark, sf):
    return bio.violations(raw_tags(spark, sf)).select("sid").distinct().orderBy("sid").limit(10)


@query("t4_most_common", "SELECT w, count(*)::BIGINT AS n FROM clean GROUP BY w ORDER BY n DESC, min(sid * 10000 + i) LIMIT 25")
def t4(spark, sf):
    n = flagged(spark, sf).groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("sid") * 10000 + F.col("i")).alias("first"))
    return n.orderBy(F.desc("n"), "first").limit(25).select("w", "n")


@query("t7_sorted_roles", "SELECT c.sid, string_agg(DISTINCT l.role, ',' ORDER BY l.role) AS roles FROM clean c JOIN lex l ON c.w = l.pattern GROUP BY c.sid")
def t7(spark, sf):
    roles = lex(spark).select("pattern", F.col("role").alias("lex_role"))
    hit = flagged(spark, sf).join(F.broadcast(roles), F.col("w") == F.col("pattern"))
    return hit.groupBy("sid").agg(F.array_join(F.array_sort(F.collect_set("lex_role")), ",").alias("roles"))


@query("u6_set_equality", "SELECT count(*)::BIGINT AS lost FROM (SELECT sid FROM bio2 EXCEPT SELECT sid FROM bio0)")
def u6_equal(spark, sf):
    return gold(spark, sf).select("sid").subtract(pred_all(spark, sf).select("sid")).agg(F.count(F.lit(1)).alias("lost"))


@query("j3_missing_ids", "SELECT DISTINCT sid FROM bio2 WHERE sid NOT IN (SELECT sid FROM pred)")
def j3(spark, sf):
    return evaluate.missing_ids(gold(spark, sf), pred(spark, sf))
