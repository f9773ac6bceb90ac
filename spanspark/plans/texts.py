"""Queries over texts: predicates and projections (P), scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import bio, lexicon, models
from spanspark.plans.registry import CLEAN, MATH, flagged, gold, long, query, sentences, table, tokens
from spanspark.plans.registry import lexicon as lex
from spanspark.plans.sequences import NORMAL

#: Tagged lines made from the sentences, damaged by arithmetic so that every reject reason occurs.
TAGGED_SQL = """WITH tl AS (SELECT sid, role, CASE sid % 6
  WHEN 0 THEN '[MATH]' || coalesce(toks[1], '') || '[/MATH] ' || text WHEN 1 THEN '[MATH]' || coalesce(toks[1], '') || '[/MATH] [MATH]' || text WHEN 2 THEN text
  WHEN 3 THEN '[/MATH]' || coalesce(toks[1], '') || '[MATH]' || text WHEN 4 THEN '[MATH]a[MATH]b[/MATH][/MATH]' || text ELSE '[MATH]a[/MATH] спаны ' || text END AS line FROM arr)"""


def tagged_lines(spark, sf):
    s, first = sentences(spark, sf), F.coalesce(F.get(T.words(F.col("text")), F.lit(0)), F.lit(""))
    k, t = F.col("sid") % 6, F.col("text")
    line = (
        F.when(k == 0, F.concat(F.lit("[MATH]"), first, F.lit("[/MATH] "), t)).when(k == 1, F.concat(F.lit("[MATH]"), first, F.lit("[/MATH] [MATH]"), t)).when(k == 2, t)
        .when(k == 3, F.concat(F.lit("[/MATH]"), first, F.lit("[MATH]"), t)).when(k == 4, F.concat(F.lit("[MATH]a[MATH]b[/MATH][/MATH]"), t)).otherwise(F.concat(F.lit("[MATH]a[/MATH] спаны "), t))
    )
    return s.select("sid", "role", line.alias("line"))


OPENED = "(length(line) - length(replace(line, '[MATH]', ''))) // 6"
CLOSED = "(length(line) - length(replace(line, '[/MATH]', ''))) // 7"
ALTERNATE = r"regexp_matches(array_to_string(list_transform(regexp_extract_all(line, '\[MATH\]|\[/MATH\]'), lambda x: CASE WHEN x = '[MATH]' THEN 'o' ELSE 'c' END), ''), '^(oc)*$')"
REASON = f"CASE WHEN {OPENED} <> {CLOSED} OR {OPENED} = 0 THEN 'counts' WHEN NOT {ALTERNATE} THEN 'nesting' WHEN regexp_matches(line, '(?i)спан') THEN 'leak' END"

META = "CASE doc_id % 5 WHEN 0 THEN 'Title: ' || text WHEN 1 THEN ' \"HTTPS://' || text WHEN 3 THEN 'SI=' || text ELSE text END"


@query("p1_metadata_filter", f"""WITH m AS (SELECT doc_id, {META} AS line FROM documents),
b AS (SELECT *, lower(trim(regexp_replace(trim(line), '^"+|"+$', '', 'g'))) AS bare FROM m)
SELECT doc_id, coalesce({" OR ".join(f"starts_with(bare, '{p}')" for p in T.METADATA_PREFIXES)}, true) AS is_metadata FROM b""")
def p1(spark, sf):
    d, t, k = table(spark, sf, "documents"), F.col("text"), F.col("doc_id") % 5
    line = F.when(k == 0, F.concat(F.lit("Title: "), t)).when(k == 1, F.concat(F.lit(' "HTTPS://'), t)).when(k == 3, F.concat(F.lit("SI="), t)).otherwise(t)
    return d.select("doc_id", T.is_metadata(line).alias("is_metadata"))


@query("p2_math_mark", "SELECT sid, i::BIGINT AS i, (n NOT IN ('_', '*', '')) OR (r NOT IN ('_', '*', '') AND contains(r, 'inception')) AS is_math FROM (SELECT sid, i, CASE (sid + i) % 4 WHEN 0 THEN '_' WHEN 1 THEN '*' WHEN 2 THEN '' ELSE w END AS n, CASE (sid + i) % 3 WHEN 0 THEN 'x.inception/' || w ELSE '_' END AS r FROM clean)")
def p2(spark, sf):
    k, r = (F.col("sid") + F.col("i")) % 4, (F.col("sid") + F.col("i")) % 3
    x = flagged(spark, sf).withColumn("n", F.when(k == 0, "_").when(k == 1, "*").when(k == 2, "").otherwise(F.col("w"))).withColumn("r", F.when(r == 0, F.concat(F.lit("x.inception/"), F.col("w"))).otherwise("_"))
    return x.select("sid", *long("i"), T.is_math_mark(F.col("n"), F.col("r")).alias("is_math"))


@query("p3_tag_counts", TAGGED_SQL + f" SELECT sid, ({OPENED})::BIGINT AS opened, ({CLOSED})::BIGINT AS closed FROM tl WHERE {OPENED} = {CLOSED} AND {OPENED} > 0")
def p3(spark, sf):
    o, c = T.tag_counts(F.col("line"))
    return tagged_lines(spark, sf).select("sid", o.cast("bigint").alias("opened"), c.cast("bigint").alias("closed")).where("opened = closed and opened > 0")


@query("p4_nesting_filter", TAGGED_SQL + f" SELECT sid, line FROM tl WHERE {ALTERNATE}")
def p4(spark, sf):
    return tagged_lines(spark, sf).where(T.tags_alternate(F.col("line"))).select("sid", "line")


@query("p5_leak_filter", TAGGED_SQL + " SELECT sid FROM tl WHERE NOT regexp_matches(line, '(?i)спан')")
def p5(spark, sf):
    return tagged_lines(spark, sf).where(~F.col("line").rlike(T.LEAK)).select("sid")


@query("p6_reject_reasons", TAGGED_SQL + f" SELECT sid, {REASON} AS reason FROM tl")
def p6(spark, sf):
    return bio.reject_reasons(tagged_lines(spark, sf).select("sid", "line"), "line")


@query("a25_reason_counters", TAGGED_SQL + f" SELECT coalesce({REASON}, 'kept') AS reason, count(*)::BIGINT AS n FROM tl GROUP BY 1")
def a25(spark, sf):
    return tagged_lines(spark, sf).groupBy(F.coalesce(T.reject_reason(F.col("line")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("p7_strip_numbering", r"SELECT sid, regexp_replace(sid::VARCHAR || CASE WHEN sid % 2 = 0 THEN '. ' ELSE ') ' END || text, '^[0-9]+[.)]\s*', '') AS line FROM sent")
def p7(spark, sf):
    line = F.concat(F.col("sid").cast("string"), F.when(F.col("sid") % 2 == 0, ". ").otherwise(") "), F.col("text"))
    return sentences(spark, sf).select("sid", T.strip_numbering(line).alias("line"))


@query("p8_min_formulas", "SELECT sid, count(*)::BIGINT AS n FROM span2 GROUP BY sid HAVING count(*) >= 2")
def p8(spark, sf):
    return bio.gap_spans(flagged(spark, sf), 2).groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("p9_length_range", "SELECT sid, len(toks)::BIGINT AS n FROM arr WHERE len(toks) BETWEEN 3 AND 25")
def p9(spark, sf):
    return sentences(spark, sf).select("sid", F.size(T.words(F.col("text"))).cast("bigint").alias("n")).where("n between 3 and 25")


SUBWORDS = "(length(tok) + 3) // 4"


@query("p10_subword_length_filter", f"SELECT sid, sum({SUBWORDS})::BIGINT AS n FROM tok GROUP BY sid HAVING sum({SUBWORDS}) <= 128")
def p10(spark, sf):
    n = F.floor((F.length("tok") + 3) / 4)
    return tokens(spark, sf).groupBy("sid").agg(F.sum(n).cast("bigint").alias("n")).where(f"n <= {models.MAX_SUBWORDS}")


@query("p11_truncate", "SELECT sid, array_to_string(toks[1:40], ' ') AS line, (len(toks) > 40) AS cut FROM arr")
def p11(spark, sf):
    w = sentences(spark, sf).select("sid", T.words(F.col("text")).alias("toks"))
    return w.select("sid", F.array_join(F.slice("toks", 1, 40), " ").alias("line"), (F.size("toks") > 40).alias("cut"))


@query("p13_regex_pattern_exclusion", r"SELECT id, pattern FROM lex WHERE NOT regexp_matches(pattern, '[\[\]\\()|+?*{}]') AND role <> 'NEGATIVE_CONTEXT'")
def p13(spark, sf):
    return lex(spark).where(~F.col("pattern").rlike(T.REGEX_CHARS) & (F.col("role") != "NEGATIVE_CONTEXT")).select("id", "pattern")


SUB_SQL = f"WITH sub AS (SELECT sid, i, tag, unnest(range({SUBWORDS})) AS part FROM bio2), o AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY i, part) - 1 AS j FROM sub)"


@query("p16_ignore_index", SUB_SQL + " SELECT sid, j::BIGINT AS j, i::BIGINT AS i, CASE WHEN part = 0 THEN CASE tag WHEN 'O' THEN 0 WHEN 'B-MATH' THEN 1 ELSE 2 END END::BIGINT AS label FROM o")
def p16(spark, sf):
    words = gold(spark, sf).select("sid", "i", "tok", bio.encode(F.col("tag")).alias("label"))
    return models.subword_labels(words.withColumn("n", F.floor((F.length("tok") + 3) / 4)), F.col("n")).select("sid", *long("j", "i", "label"))


@query("p17_label_codes", "SELECT sid, i::BIGINT AS i, CASE tag WHEN 'O' THEN 0 WHEN 'B-MATH' THEN 1 ELSE 2 END::BIGINT AS code, tag AS back FROM bio2")
def p17(spark, sf):
    c = bio.encode(F.col("tag"))
    return gold(spark, sf).select("sid", *long("i"), c.cast("bigint").alias("code"), bio.decode(c).alias("back"))


@query("p18_constant_columns", "SELECT sid, i::BIGINT AS i, tok, tag, 'conversations' AS source, 'val' AS split FROM bio2")
def p18(spark, sf):
    return gold(spark, sf).select("sid", *long("i"), "tok", "tag", F.lit("conversations").alias("source"), F.lit("val").alias("split"))


@query("f1_whitespace_tokens", "SELECT sid, i::BIGINT AS i, tok FROM tok")
def f1(spark, sf):
    return tokens(spark, sf).select("sid", *long("i"), "tok")


PARSED = r"""WITH src AS (SELECT sid, string_split_regex(line, '\[MATH\]|\[/MATH\]') AS ps FROM tl),
parts AS (SELECT sid, unnest(range(len(ps))) AS part, unnest(ps) AS chunk FROM src),
wrd AS (SELECT sid, part, list_filter(string_split_regex(chunk, '\s+'), lambda x: x <> '') AS ws FROM parts),
each AS (SELECT sid, part, unnest(range(len(ws))) AS j, unnest(ws) AS tok FROM wrd)
SELECT sid, (row_number() OVER (PARTITION BY sid ORDER BY part, j) - 1)::BIGINT AS i, tok, CASE WHEN part % 2 = 0 THEN 'O' WHEN j = 0 THEN 'B-MATH' ELSE 'I-MATH' END AS tag FROM each"""


@query("f2_parse_tagged", TAGGED_SQL + "," + PARSED[5:])
def f2(spark, sf):
    return bio.parse_tagged(tagged_lines(spark, sf), "line").select("sid", *long("i"), "tok", "tag")


@query("f3_word_punct_tokens", r"WITH p AS (SELECT sid, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS ps FROM sent) SELECT sid, unnest(range(len(ps)))::BIGINT AS i, unnest(ps) AS tok FROM p")
def f3(spark, sf):
    return sentences(spark, sf).select("sid", F.posexplode(T.words_and_marks(F.col("text"))).alias("i", "tok")).select("sid", *long("i"), "tok")


@query("f4_clean_word", f"SELECT sid, i::BIGINT AS i, w, regexp_replace(tok, '^[^\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+$', '', 'g') AS cased FROM clean")
def f4(spark, sf):
    return tokens(spark, sf).select("sid", *long("i"), T.clean_word(F.col("tok")).alias("w"), T.clean_word(F.col("tok"), lower=False).alias("cased"))


@query("f5_normal_token", f"SELECT sid, i::BIGINT AS i, {NORMAL.format(t='tok')} AS w FROM tok")
def f5(spark, sf):
    return tokens(spark, sf).select("sid", *long("i"), T.normal_token(F.col("tok")).alias("w"))


@query("f6_phrase_tokens", rf"SELECT id, array_to_string(list_filter(list_transform(regexp_extract_all(pattern, '[\p{{L}}\p{{N}}_]+'), lambda x: {NORMAL.format(t='x')}), lambda x: x <> ''), ' ') AS phrase FROM lex")
def f6(spark, sf):
    return lex(spark).select("id", F.array_join(T.phrase_tokens(F.col("pattern")), " ").alias("phrase"))


@query("f7_word_shape", r"SELECT sid, i::BIGINT AS i, regexp_replace(regexp_replace(regexp_replace(tok, '\p{Lu}', 'X', 'g'), '\p{Ll}', 'x', 'g'), '\p{Nd}', 'd', 'g') AS shape FROM tok")
def f7(spark, sf):
    return tokens(spark, sf).select("sid", *long("i"), T.word_shape(F.col("tok")).alias("shape"))


@query("f8_affixes", "SELECT sid, i::BIGINT AS i, left(tok, 3) AS prefix3, right(tok, 3) AS suffix3 FROM tok")
def f8(spark, sf):
    p, s = T.affixes(F.col("tok"))
    return tokens(spark, sf).select("sid", *long("i"), p.alias("prefix3"), s.alias("suffix3"))


@query("f9_surface_flags", r"SELECT sid, i::BIGINT AS i, regexp_matches(tok, '^[0-9]+$') AS is_digit, regexp_matches(tok, '^[a-zA-Z]+$') AS is_latin, regexp_matches(tok, '[\p{Lu}\p{Lt}]') AND NOT regexp_matches(tok, '\p{Ll}') AS is_upper, regexp_matches(left(tok, 1), '\p{Lu}') AS is_title, length(tok)::BIGINT AS length FROM tok")
def f9(spark, sf):
    return tokens(spark, sf).select("sid", *long("i"), *(c.alias(k) for k, c in T.surface_flags(F.col("tok")).items()))


LIKE_SQL = f"""WITH m AS (SELECT sid, i, CASE (sid + i) % 5 WHEN 0 THEN (sid % 90)::VARCHAR || ',' WHEN 1 THEN 'x' || (i % 10)::VARCHAR WHEN 2 THEN (i % 10)::VARCHAR || 'ab.' ELSE tok END AS t0 FROM tok),
t AS (SELECT *, regexp_replace(t0, '^[.,!?;:²³]+|[.,!?;:²³]+$', '', 'g') AS t FROM m)
SELECT sid, i::BIGINT AS i, CASE WHEN t = '' THEN -10 WHEN regexp_matches(t, '^[0-9]+$') THEN 5 WHEN regexp_matches(t, '^[a-zA-Z][0-9]?$') THEN 5
  WHEN regexp_matches(t, '^[0-9]+[a-zA-Zа-яА-ЯёЁ]{{1,2}}$') OR regexp_matches(t, '^[a-zA-Zа-яА-ЯёЁ]{{1,2}}[0-9]+$') THEN 4 WHEN lower(t) IN ({", ".join(f"'{m}'" for m in MATH)}) THEN 3
  WHEN length(t) <= 2 AND t IN ('in', 'to') THEN 0 ELSE -2 END::BIGINT AS score FROM t"""


@query("f10_math_likeness", LIKE_SQL)
def f10(spark, sf):
    k, i = (F.col("sid") + F.col("i")) % 5, F.col("i") % 10
    t = F.when(k == 0, F.concat((F.col("sid") % 90).cast("string"), F.lit(","))).when(k == 1, F.concat(F.lit("x"), i.cast("string"))).when(k == 2, F.concat(i.cast("string"), F.lit("ab."))).otherwise(F.col("tok"))
    return tokens(spark, sf).select("sid", *long("i"), T.math_likeness(t, MATH, ("in", "to")).cast("bigint").alias("score"))


@query("f11_punct_predicates", r"WITH p AS (SELECT sid, unnest(regexp_extract_all(text, '[^\p{L}\p{N}_\s]+')) AS tok FROM sent) SELECT tok, regexp_matches(tok, '^[,.!?;:]+$') AS score, regexp_matches(tok, '^[.,;!?]+$') AS outside, tok IN ('.', '?', '!', ';', ':') AS strong, count(*)::BIGINT AS n FROM p GROUP BY tok")
def f11(spark, sf):
    p = sentences(spark, sf).select(F.explode(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}_\s]+"), F.lit(0))).alias("tok"))
    return p.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).select("tok", F.col("tok").rlike(T.PUNCT_SCORE).alias("score"), F.col("tok").rlike(T.PUNCT_OUTSIDE).alias("outside"), F.col("tok").isin(*T.STRONG_PUNCT).alias("strong"), "n")


@query("f12_word_predicates", r"SELECT sid, i::BIGINT AS i, regexp_matches(tok, '[\p{L}\p{N}_]') AS wordlike, regexp_matches(w, '^\p{L}$') AS single_letter, w IN ('the', 'in') AS relation FROM clean")
def f12(spark, sf):
    return flagged(spark, sf).select("sid", *long("i"), F.col("tok").rlike(r"[\p{L}\p{N}_]").alias("wordlike"), F.col("w").rlike(r"^\p{L}$").alias("single_letter"), F.col("w").isin("the", "in").alias("relation"))


#: Response blocks made from the benchmark: two or three marked formulas, out of order, with and without latex lines.
BLOCK_SQL = r"""WITH bl AS (SELECT item_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
blk AS (SELECT item_id, 'SENTENCE: <F2>' || w[1] || '</F2> ' || w[2] || ' <F1>' || w[3] || '</F1>' || CASE WHEN item_id % 2 = 0 THEN ' <F3>' || w[4] || '</F3>' ELSE '' END || chr(10) || 'F1: `x_' || item_id || '`' || chr(10) || CASE WHEN item_id % 3 = 0 THEN 'F2: y' || chr(10) || 'F2: z' ELSE '' END AS block FROM bl)"""


def blocks(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", T.words(F.col("text")).alias("w"))
    g = lambda k: F.get("w", F.lit(k))
    line = F.concat(F.lit("SENTENCE: <F2>"), g(0), F.lit("</F2> "), g(1), F.lit(" <F1>"), g(2), F.lit("</F1>"), F.when(F.col("item_id") % 2 == 0, F.concat(F.lit(" <F3>"), g(3), F.lit("</F3>"))).otherwise(""), F.lit("\nF1: `x_"), F.col("item_id").cast("string"), F.lit("`\n"), F.when(F.col("item_id") % 3 == 0, "F2: y\nF2: z").otherwise(""))
    return w.select("item_id", line.alias("block"))


FORMULAS = """SELECT item_id, id::BIGINT AS id, spoken, latex FROM (
  SELECT item_id, 1 AS id, regexp_extract(block, '<F1>(.*?)</F1>', 1) AS spoken, 'x_' || item_id AS latex FROM blk UNION ALL
  SELECT item_id, 2, regexp_extract(block, '<F2>(.*?)</F2>', 1), CASE WHEN item_id % 3 = 0 THEN 'z' ELSE '???' END FROM blk UNION ALL
  SELECT item_id, 3, regexp_extract(block, '<F3>(.*?)</F3>', 1), '???' FROM blk WHERE item_id % 2 = 0)"""


@query("f13_response_formulas", BLOCK_SQL + " " + FORMULAS)
def f13(spark, sf):
    each = blocks(spark, sf).select("item_id", F.explode(T.response_formulas(F.col("block"))).alias("x"))
    return each.select("item_id", F.col("x.id").cast("bigint").alias("id"), "x.spoken", "x.latex")


@query("j8_latex_default", BLOCK_SQL + f" SELECT latex = '???' AS missing, count(*)::BIGINT AS n FROM ({FORMULAS}) GROUP BY 1")
def j8(spark, sf):
    return f13(spark, sf).groupBy((F.col("latex") == "???").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("f14_tag_rewrite", BLOCK_SQL + r" SELECT item_id, regexp_replace(regexp_replace(regexp_extract(block, 'SENTENCE:\s*([^\n]*)', 1), '<F[0-9]+>', '[MATH]', 'g'), '</F[0-9]+>', '[/MATH]', 'g') AS tagged, regexp_replace(regexp_extract(block, 'SENTENCE:\s*([^\n]*)', 1), '</?F[0-9]+>', '', 'g') AS plain FROM blk")
def f14(spark, sf):
    s = T.response_sentence(F.col("block"))
    return blocks(spark, sf).select("item_id", T.response_tagged(s).alias("tagged"), F.regexp_replace(s, "</?F[0-9]+>", "").alias("plain"))


@query("f15_formula_pivot", BLOCK_SQL + f", fm AS ({FORMULAS}) SELECT item_id, count(*)::BIGINT AS num_formulas, coalesce(max(CASE WHEN id = 1 THEN spoken END), '') AS f1_pron, coalesce(max(CASE WHEN id = 2 THEN spoken END), '') AS f2_pron, coalesce(max(CASE WHEN id = 3 THEN spoken END), '') AS f3_pron, coalesce(max(CASE WHEN id = 3 THEN latex END), '') AS f3_latex FROM fm GROUP BY item_id")
def f15(spark, sf):
    x = blocks(spark, sf).select("item_id", T.response_formulas(F.col("block")).alias("f"))
    at = lambda k, c: F.coalesce(F.get("f", F.lit(k))[c], F.lit(""))
    return x.select("item_id", F.size("f").cast("bigint").alias("num_formulas"), *(at(k, "spoken").alias(f"f{k + 1}_pron") for k in range(3)), at(2, "latex").alias("f3_latex"))


@query("f16_alnum_chars", r"SELECT ch, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(tok), '[\p{L}\p{N}]')) AS ch FROM tok) GROUP BY ch")
def f16(spark, sf):
    return tokens(spark, sf).select(F.explode(T.alnum_chars(F.col("tok"))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


@query("f17_safe_id", "SELECT sid, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(text, '[^0-9A-Za-zА-Яа-яЁё_-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'input') AS safe FROM sent")
def f17(spark, sf):
    return sentences(spark, sf).select("sid", T.safe_id(F.col("text")).alias("safe"))


@query("f18_resample_mask", """WITH m AS (SELECT sid, greatest(1, len(toks) // 2)::BIGINT AS n, array_to_string(list_transform(range(len(toks)), lambda x: CASE WHEN (x * 7 + sid) % 3 = 0 THEN '1' ELSE '0' END), '') AS mask FROM arr),
e AS (SELECT sid, n, mask, unnest(range(n)) AS k FROM m),
b AS (SELECT *, round_even(k * length(mask) / n::DOUBLE, 0)::INT AS lo, round_even((k + 1) * length(mask) / n::DOUBLE, 0)::INT AS hi FROM e),
p AS (SELECT *, substring(mask, lo + 1, hi - lo) AS part FROM b)
SELECT sid, string_agg(CASE WHEN 2 * length(replace(part, '0', '')) > length(part) THEN '1' ELSE '0' END, '' ORDER BY k) AS bits FROM p GROUP BY sid""")
def f18(spark, sf):
    n = F.size(T.words(F.col("text")))
    x = sentences(spark, sf).select("sid", n.alias("size"), F.greatest(F.lit(1), F.floor(n / 2).cast("int")).alias("n"))
    mask = F.when(F.col("size") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.when((k * 7 + F.col("sid")) % 3 == 0, "1").otherwise("0")), "")).otherwise("")
    return x.withColumn("mask", mask).select("sid", T.resample_mask(F.col("n"), F.col("mask")).alias("bits"))


@query("f19_char_spans", "SELECT sid, i::BIGINT AS i, (sum(length(tok) + 1) OVER (PARTITION BY sid ORDER BY i) - length(tok) - 1)::BIGINT AS start_char, (sum(length(tok) + 1) OVER (PARTITION BY sid ORDER BY i) - 1)::BIGINT AS end_char FROM tok")
def f19(spark, sf):
    end = F.sum(F.length("tok") + 1).over(bio.to_here()) - 1
    return tokens(spark, sf).select("sid", *long("i"), (end - F.length("tok")).cast("bigint").alias("start_char"), end.cast("bigint").alias("end_char"))


@query("f20_token_bound_regex", "WITH g AS (SELECT sid, i AS s, w || ' ' || lead(w) OVER (PARTITION BY sid ORDER BY i) AS g FROM (SELECT sid, i, " + NORMAL.format(t="tok") + " AS w FROM tok)) SELECT sid, s::BIGINT AS s, (s + 2)::BIGINT AS e FROM g WHERE regexp_full_match(g, 'is (to|a)|of (the|a)')")
def f20(spark, sf):
    rule = spark.createDataFrame([(0, "r", "is (to|a)|of (the|a)", "OPERATOR", "regex")], "ord int, id string, pattern string, role string, match_type string")
    return lexicon.regex_spans(tokens(spark, sf).select("sid", "i", "tok"), rule).select("sid", *long("s", "e"))


@query("f21_prompt", "SELECT item_id // 5 AS batch, 'Write ' || count(*) || ' sentences.' || chr(10) || string_agg(item_id || '. ' || text, chr(10) ORDER BY item_id) AS prompt FROM benchmark GROUP BY item_id // 5")
def f21(spark, sf):
    line = F.concat(F.col("item_id").cast("string"), F.lit(". "), F.col("text"))
    g = table(spark, sf, "benchmark").groupBy(F.floor(F.col("item_id") / 5).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("item_id", line.alias("line")))).alias("x"))
    return g.select("batch", F.concat_ws("\n", F.format_string("Write %d sentences.", "n"), F.array_join("x.line", "\n")).alias("prompt"))


@query("f22_f1_safe", "SELECT role, round(coalesce(2.0 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT role, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM (SELECT role, count(*) FILTER (math) AS tp, count(*) FILTER (i = 0) AS fp, count(*) FILTER (w = 'zzz') AS fn FROM flag GROUP BY role))")
def f22(spark, sf):
    n = flagged(spark, sf).groupBy("role").agg(F.count_if("math").alias("tp"), F.count_if(F.col("i") == 0).alias("fp"), F.count_if(F.col("w") == "zzz").alias("fn"))
    return n.select("role", F.round(T.f1(F.col("tp"), F.col("fp"), F.col("fn"))["f1"], 6).alias("f1"))


@query("f23_json", """SELECT sid, '{"sid":' || sid || ',"n":' || len(toks) || ',"role":"' || role || '"}' AS json FROM arr""")
def f23(spark, sf):
    return sentences(spark, sf).select("sid", F.to_json(F.struct(F.col("sid"), F.size(T.words(F.col("text"))).alias("n"), F.col("role"))).alias("json"))


@query("f24_carrier_split", "WITH c(id, parts) AS (VALUES (1, ['Let', '{MATH}', '.']), (2, ['{MATH}', '.', '']), (3, ['If', '{MATH}', ', then done .'])) SELECT id::BIGINT AS id, trim(array_to_string(parts[1:list_position(parts, '{MATH}') - 1], ' ')) AS prefix, trim(array_to_string(parts[list_position(parts, '{MATH}') + 1:], ' ')) AS suffix FROM c")
def f24(spark, sf):
    c = spark.createDataFrame([(1, ["Let", "{MATH}", "."]), (2, ["{MATH}", ".", ""]), (3, ["If", "{MATH}", ", then done ."])], "id bigint, parts array<string>")
    at = F.array_position("parts", F.lit("{MATH}")).cast("int")
    part = lambda a, n: F.trim(F.array_join(F.slice("parts", a, n), " "))
    return c.select("id", part(F.lit(1), at - 1).alias("prefix"), part(at + 1, F.size("parts") - at).alias("suffix"))


@query("f25_render", "SELECT sid, string_agg(tok || '/' || tag, ' ' ORDER BY i) AS line FROM bio2 GROUP BY sid")
def f25(spark, sf):
    return bio.assemble(gold(spark, sf).withColumn("x", F.concat_ws("/", "tok", "tag")), "x").select("sid", F.array_join("x", " ").alias("line"))


@query("p12_vocab_admission", f"SELECT {CLEAN.format(t='tok')} AS word, count(*)::BIGINT AS n FROM tok WHERE length({CLEAN.format(t='tok')}) >= 2 GROUP BY 1 HAVING count(*) >= 5 AND word NOT IN ('of', 'in')")
def p12(spark, sf):
    from spanspark.operators.features import corpus_words

    return corpus_words(tokens(spark, sf), 5, ("of", "in"))
