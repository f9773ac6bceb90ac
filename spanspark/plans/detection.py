"""Queries of the span detectors (H), of clustering and merging (W8, W9), augmentation (G), models (M) and noise baselines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from spanspark.operators import align, bio, corpus, crf, dependency, evaluate, features, lexicon, models
from spanspark.plans.registry import LEXICON, LONGEST, MATH, RECURSIVE, RUN, flagged, gold, long, query, sentences, table, tokens
from spanspark.plans.registry import lexicon as lex
from spanspark.plans.relations import GRAMS, NGRAMS, SPLIT3, split3
from spanspark.plans.sequences import NORMAL, STRONG

#: Anchors for clustering: lexicon candidates of one word.
ANCHORS = NGRAMS + ", anc AS (SELECT sid, s, e, role, id FROM cand WHERE role NOT IN ('NEGATIVE_CONTEXT', 'BOUNDARY', 'BOUNDARY_AMBIGUOUS', 'END_CONTEXT', 'DISCOURSE_START'))"
CLUSTERS = """, pe AS (SELECT *, max(e) OVER (PARTITION BY sid ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM anc WHERE role <> 'CONNECTIVE'),
kk AS (SELECT *, sum(coalesce((s - pe > 3)::INT, 0)) OVER (PARTITION BY sid ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM pe),
clu AS (SELECT sid, min(s) AS s, max(e) AS e, count(*) AS n, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM kk GROUP BY sid, k)"""


def anchors(spark, sf):
    found = lexicon.candidates(tokens(spark, sf).select("sid", "i", "tok"), lex(spark), LONGEST)
    return found.where(F.col("role").isin(*lexicon.POSITIVE_ROLES))


@query("w9_anchor_clusters", ANCHORS + CLUSTERS + " SELECT sid, s::BIGINT AS s, e::BIGINT AS e, n::BIGINT AS n, roles FROM clu")
def w9(spark, sf):
    return lexicon.clusters(anchors(spark, sf)).select("sid", *long("s", "e"), "n", "roles")


@query("h9_split_by_anchor_gaps", """WITH pe AS (SELECT sid, s AS span, i AS s, i + 1 AS e, max(i + 1) OVER (PARTITION BY sid, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM (SELECT f.sid, x.s, f.i FROM flag f JOIN (SELECT sid, i // 20 AS s, min(i) AS lo, max(i) AS hi FROM tok GROUP BY 1, 2) x ON f.sid = x.sid AND f.i BETWEEN x.lo AND x.hi WHERE f.math)),
kk AS (SELECT *, sum(coalesce((s - pe > 3)::INT, 0)) OVER (PARTITION BY sid, span ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM pe) SELECT sid, span::BIGINT AS span, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM kk GROUP BY sid, span, k""")
def h9(spark, sf):
    a = flagged(spark, sf).where("math").select("sid", (F.col("i") / 20).cast("int").alias("span"), F.col("i").alias("s"), (F.col("i") + 1).alias("e"), F.lit("RELATION").alias("role"), F.col("w").alias("id"))
    return lexicon.clusters(a, within=("sid", "span")).select("sid", *long("span", "s", "e"))


MERGED = f"""WITH iv AS (SELECT sid, i AS s, i + 1 + (i * 7 + sid) % 4 AS e0 FROM flag WHERE math), nw AS (SELECT sid, max(i) + 1 AS n FROM tok GROUP BY sid),
sp AS (SELECT sid, s, least(e0, n) AS e FROM iv JOIN nw USING (sid)),
cut AS (SELECT sid, i, regexp_matches(tok, {STRONG}) AS ends, sum((regexp_matches(tok, {STRONG}) OR {NORMAL.format(t='tok')} IN ('а', 'но', 'однако', 'зато'))::INT) OVER ({RUN} CURRENT ROW) AS c FROM tok),
pe AS (SELECT *, max(e) OVER (PARTITION BY sid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM sp),
j AS (SELECT pe.*, coalesce(pe > s OR (s - pe <= 2 AND b.c - a.c = 0 AND NOT a.ends), false) AS joined FROM pe LEFT JOIN cut a ON a.sid = pe.sid AND a.i = pe.pe - 1 LEFT JOIN cut b ON b.sid = pe.sid AND b.i = pe.s - 1),
k AS (SELECT *, sum((NOT joined)::INT) OVER (PARTITION BY sid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM j)
SELECT sid, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM k GROUP BY sid, k"""


@query("w8_interval_merge", MERGED)
def w8(spark, sf):
    t = tokens(spark, sf)
    n = t.groupBy("sid").agg((F.max("i") + 1).alias("n"))
    iv = flagged(spark, sf).where("math").select("sid", F.col("i").alias("s"), (F.col("i") + 1 + ((F.col("i") * 7 + F.col("sid")) % 4).cast("int")).alias("e0"))
    spans = iv.join(n, "sid").select("sid", "s", F.least("e0", "n").alias("e"))
    return lexicon.merge(spans, t.select("sid", "i", "tok")).select("sid", *long("s", "e"))


@query("h7_variable_noise", "WITH v AS (SELECT sid, i, math FROM flag WHERE length(w) <= 2 OR math) SELECT v.sid, v.i::BIGINT AS i FROM v WHERE NOT math AND EXISTS (SELECT 1 FROM flag a WHERE a.sid = v.sid AND a.math AND a.i BETWEEN v.i - 3 AND v.i + 3)")
def h7(spark, sf):
    f = flagged(spark, sf)
    return lexicon.near_anchor(f.where("length(w) <= 2 and not math").select("sid", "i"), f.where("math").select("sid", "i")).select("sid", *long("i"))


@query("h8_boundary_trim", f"""WITH kept AS (SELECT f.sid, x.s AS span, f.i, (f.sid + f.i) % 5 IN (0, 1, 4) AS lead_like, f.math AS anchor FROM flag f JOIN span2 x ON f.sid = x.sid AND f.i >= x.s AND f.i < x.e WHERE f.w NOT IN ('de', 'and')),
c AS (SELECT sid, i, sum(regexp_matches(tok, {STRONG})::INT) OVER ({RUN} CURRENT ROW) - regexp_matches(tok, {STRONG})::INT AS before FROM tok),
p AS (SELECT * FROM (SELECT k.*, c.before, first_value(c.before) OVER (PARTITION BY k.sid, k.span ORDER BY k.i) AS b0 FROM kept k JOIN c USING (sid, i)) WHERE before = b0),
f AS (SELECT *, coalesce(min(CASE WHEN anchor OR NOT lead_like THEN i END) OVER (PARTITION BY sid, span), max(i) OVER (PARTITION BY sid, span)) AS fst FROM p)
SELECT sid, span::BIGINT AS span, min(i)::BIGINT AS s, (max(i) + 1)::BIGINT AS e FROM f WHERE i >= fst GROUP BY sid, span""")
def h8(spark, sf):
    from spanspark.plans.sequences import with_upos

    f = flagged(spark, sf)
    inside = bio.gap_spans(f, 2).select("sid", F.col("s").alias("span"), F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i"))
    kept = with_upos(f).where(~F.col("w").isin("de", "and")).join(inside, ["sid", "i"]).select("sid", "span", "i", "upos", F.col("math").alias("anchor"))
    whole = lexicon.prefix_until_break(kept.select("sid", "span", "i"), f.select("sid", "i", "tok")).join(kept, ["sid", "span", "i"])
    return lexicon.trim_leading(whole).groupBy("sid", "span").agg(F.min("i").alias("s"), (F.max("i") + 1).alias("e")).select("sid", *long("span", "s", "e"))


@query("h10_context_suppression", ANCHORS + CLUSTERS + f""", pv AS (SELECT c.*, {NORMAL.format(t='t.tok')} AS prev FROM clu c LEFT JOIN tok t ON t.sid = c.sid AND t.i = c.s - 1)
SELECT sid, s::BIGINT AS s, e::BIGINT AS e, roles FROM pv WHERE NOT (len(list_filter(string_split(roles, ','), lambda r: r NOT IN ('OBJECT', 'VARIABLE', 'CONNECTIVE'))) = 0 AND coalesce(prev IN ('et', 'in', 'of'), false))""")
def h10(spark, sf):
    c = lexicon.clusters(anchors(spark, sf))
    return lexicon.suppress(c, tokens(spark, sf).select("sid", "i", "tok"), ("et", "in", "of")).select("sid", *long("s", "e"), "roles")


BARRED = "('NEGATIVE_CONTEXT', 'BOUNDARY', 'BOUNDARY_AMBIGUOUS', 'END_CONTEXT', 'DISCOURSE_START')"
#: The greedy choice, one candidate of each sentence after the other; the lexicon's regexes are of two words each.
KEPT = f""", alls AS (SELECT sid, s, e, role, id, ord, 0 AS rx FROM cand UNION ALL SELECT g.sid, g.i, g.i + 2, l.role, l.id, l.ord, 1 FROM g JOIN lex l ON l.match_type = 'regex' AND g.size = 2 AND regexp_full_match(g.key, l.pattern)),
ranked AS MATERIALIZED (SELECT *, role IN {BARRED} AS b, row_number() OVER (PARTITION BY sid ORDER BY rx, s - e, ord, s) AS k FROM alls),
walk AS (SELECT sid, 0::BIGINT AS k, false AS free, []::BIGINT[] AS pos, []::BIGINT[] AS bnd FROM (SELECT DISTINCT sid FROM ranked)
  UNION ALL SELECT sid, k, free, CASE WHEN free AND NOT b THEN pos || range(s, e) ELSE pos END, CASE WHEN free AND b AND rx = 0 THEN bnd || range(s, e) ELSE bnd END
  FROM (SELECT r.*, w.pos, w.bnd, CASE WHEN r.rx = 1 AND r.b THEN true WHEN r.b THEN NOT list_has_any(w.bnd, range(r.s, r.e)) ELSE NOT list_has_any(w.pos, range(r.s, r.e)) END AS free FROM walk w JOIN ranked r ON r.sid = w.sid AND r.k = w.k + 1)),
kept AS MATERIALIZED (SELECT r.sid, r.s, r.e, r.role, r.id, r.ord, r.b FROM walk w JOIN ranked r ON r.sid = w.sid AND r.k = w.k WHERE w.free)"""


@query("h2_greedy_matching", NGRAMS + KEPT + " SELECT sid, s::BIGINT AS s, e::BIGINT AS e, role, id FROM kept", base=RECURSIVE)
def h2(spark, sf):
    return lexicon.matches(tokens(spark, sf).select("sid", "i", "tok"), lex(spark), LONGEST).select("sid", *long("s", "e"), "role", "id")


ONE_WORD = NGRAMS + """, one AS (SELECT *, role IN ('NEGATIVE_CONTEXT', 'BOUNDARY', 'BOUNDARY_AMBIGUOUS', 'END_CONTEXT', 'DISCOURSE_START') AS cls FROM cand WHERE e = s + 1)
SELECT sid, s::BIGINT AS s, arg_min(role, ord) AS role, arg_min(id, ord) AS id FROM one GROUP BY sid, s, cls"""


@query("h2_greedy_matching_words", ONE_WORD)
def h2_words(spark, sf):
    found = lexicon.candidates(tokens(spark, sf).select("sid", "i", "tok"), lex(spark), 1)
    return lexicon.resolve(found).select("sid", *long("s"), "role", "id")


@query("h12_detect_lexical", NGRAMS + KEPT + ", anc AS (SELECT sid, s, e, role, id FROM kept WHERE NOT b)" + CLUSTERS + f""", pv AS (SELECT c.*, {NORMAL.format(t='t.tok')} AS prev FROM clu c LEFT JOIN tok t ON t.sid = c.sid AND t.i = c.s - 1)
SELECT sid, s::BIGINT AS s, e::BIGINT AS e, roles FROM pv WHERE NOT (len(list_filter(string_split(roles, ','), lambda r: r NOT IN ('OBJECT', 'VARIABLE', 'CONNECTIVE'))) = 0 AND coalesce(prev IN ('про', 'о', 'об'), false))""", base=RECURSIVE)
def h12_lexical(spark, sf):
    t = tokens(spark, sf).select("sid", "i", "tok")
    return lexicon.detect_lexical(t, lex(spark), LONGEST).select("sid", *long("s", "e"), "roles")


def parsed(spark, sf):
    """A stand-in parse of the sentences: marks are tokens, heads and labels come from arithmetic; every sixth token is a root."""
    each = sentences(spark, sf).select("sid", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0))).alias("idx", "text"))
    k = (F.col("sid") + F.col("idx")) % 6
    upos = F.when(F.col("text").rlike(r"^[^\p{L}\p{N}_]$"), "PUNCT").when(k == 0, "ADP").when(k == 1, "VERB").otherwise("NOUN")
    deprel = F.when(k == 0, "case").when(k == 1, "root").when(k == 2, "nsubj").when(k == 3, "nmod").when(k == 4, "obj").otherwise("punct")
    return each.select("sid", "idx", "text", F.lower("text").alias("lemma"), upos.alias("upos"), F.when((k != 1) & (F.col("idx") > 0), F.greatest(F.lit(0), F.col("idx") - 1 - F.col("idx") % 2)).alias("head"), deprel.alias("deprel"), F.lit(0).alias("sent"))


@query("h12_detect_dependency")
def h12_dependency(spark, sf):
    return dependency.detect(parsed(spark, sf), [x[:5] for x in LEXICON]).select("sid", *long("pos"), "tok", "deprel", "tag")


def expanded(spark, sf, *columns):
    return dependency.expansions(parsed(spark, sf), [x[:5] for x in LEXICON]).select("sid", *long("s", "e"), "id", *long(*columns))


listed = lambda xs: "(" + ", ".join(f"'{x}'" for x in sorted(xs)) + ")"
#: The stand-in parse, its matches, anchors, closure, ways up, and what each match expands to.
PARSE = rf"""WITH t0 AS (SELECT sid, unnest(range(len(ps)))::INT AS idx, unnest(ps) AS text FROM (SELECT sid, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS ps FROM sent)),
t1 AS (SELECT *, regexp_full_match(text, '[^\p{{L}}\p{{N}}_]') AS mark, (sid + idx) % 6 AS k, {NORMAL.format(t='text')} AS form, (text IN ('.', '?', '!', ';', ':'))::INT AS strong FROM t0),
t2 AS (SELECT *, CASE k WHEN 0 THEN 'case' WHEN 1 THEN 'root' WHEN 2 THEN 'nsubj' WHEN 3 THEN 'nmod' WHEN 4 THEN 'obj' ELSE 'punct' END AS deprel, CASE WHEN k <> 1 AND idx > 0 THEN greatest(0, idx - 1 - idx % 2) END AS head,
  regexp_full_match(form, '\p{{L}}') AS letter, (mark OR k <> 0) AND (form IN {listed(dependency.VARIABLE_WORDS)} OR regexp_full_match(form, '\p{{L}}')) AS variable, form IN {listed(dependency.RELATION_LEMMAS)} AS relation,
  coalesce(sum(strong) OVER (PARTITION BY sid ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sc FROM t1),
tk AS MATERIALIZED (SELECT *, deprel IN {listed(dependency.HEAD_DEPRELS)} OR relation OR variable AS may_head FROM t2),
wd AS MATERIALIZED (SELECT sid, idx, form, row_number() OVER (PARTITION BY sid ORDER BY idx) - 1 AS place FROM tk WHERE NOT mark),
nt AS (SELECT sid, place AS i, form AS w FROM wd)""" + GRAMS + KEPT + f""",
an AS MATERIALIZED (SELECT DISTINCT w.sid, w.idx FROM kept k JOIN wd w ON w.sid = k.sid AND w.place >= k.s AND w.place < k.e WHERE NOT k.b),
ed AS MATERIALIZED (SELECT t.sid, t.idx, t.head FROM tk t JOIN tk h ON h.sid = t.sid AND h.idx = t.head LEFT JOIN an a ON a.sid = t.sid AND a.idx = t.head WHERE (a.idx IS NOT NULL OR h.relation OR h.variable) AND t.sc - h.sc - h.strong = 0),
way AS (SELECT k.sid, k.s, k.e, k.id, w.idx AS start, w.idx AS at, 0 AS step FROM kept k JOIN wd w ON w.sid = k.sid AND w.place = k.s WHERE NOT k.b UNION ALL SELECT w.sid, w.s, w.e, w.id, w.start, ed.head, w.step + 1 FROM way w JOIN ed ON ed.sid = w.sid AND ed.idx = w.at),
hd AS MATERIALIZED (SELECT w.sid, w.s, w.e, w.id, coalesce(arg_max(w.at, w.step) FILTER (t.may_head), any_value(w.start)) AS head FROM way w JOIN tk t ON t.sid = w.sid AND t.idx = w.at GROUP BY w.sid, w.s, w.e, w.id),
al AS (SELECT sid, idx AS node, idx AS top FROM tk UNION SELECT a.sid, a.node, t.head FROM al a JOIN tk t ON t.sid = a.sid AND t.idx = a.top WHERE t.head IS NOT NULL)"""


@query("h4_math_head_climb", PARSE + " SELECT h.sid, h.s::BIGINT AS s, h.e::BIGINT AS e, h.id, h.head::BIGINT AS head, count(*)::BIGINT AS subtree FROM hd h JOIN al ON al.sid = h.sid AND al.top = h.head GROUP BY ALL", base=RECURSIVE)
def h4(spark, sf):
    return expanded(spark, sf, "head", "subtree")


@query("h5_relation_expansion", PARSE + f""" SELECT h.sid, h.s::BIGINT AS s, h.e::BIGINT AS e, h.id, h.head::BIGINT AS head, count(DISTINCT al.node)::BIGINT AS relation
FROM hd h LEFT JOIN tk r ON r.sid = h.sid AND r.idx = h.head AND r.relation LEFT JOIN tk c ON c.sid = r.sid AND c.head = r.idx AND c.deprel IN {listed(dependency.RELATION_CHILD_DEPRELS)} LEFT JOIN al ON al.sid = c.sid AND al.top = c.idx GROUP BY h.sid, h.s, h.e, h.id, h.head""", base=RECURSIVE)
def h5(spark, sf):
    return expanded(spark, sf, "head", "relation")


@query("h6_anchored_expansion", PARSE + f""", seeds AS (SELECT sid, idx FROM an UNION SELECT sid, idx FROM tk WHERE variable),
tops AS (SELECT DISTINCT t.sid, t.idx FROM tk t JOIN al ON al.sid = t.sid AND al.top = t.idx JOIN seeds s ON s.sid = al.sid AND s.idx = al.node WHERE t.head IS NOT NULL AND t.deprel IN {listed(dependency.EXPANSION_DEPRELS)}),
wide AS (SELECT DISTINCT al.sid, al.node FROM al JOIN tops ON tops.sid = al.sid AND tops.idx = al.top),
held AS MATERIALIZED (SELECT h.sid, h.s, h.id, al.node FROM hd h JOIN al ON al.sid = h.sid AND al.top = h.head UNION SELECT h.sid, h.s, h.id, w.idx FROM hd h JOIN wd w ON w.sid = h.sid AND w.place >= h.s AND w.place < h.e UNION SELECT h.sid, h.s, h.id, x.node FROM hd h JOIN wide x ON x.sid = h.sid),
n AS (SELECT sid, s, id, count(*) AS n FROM held GROUP BY sid, s, id),
stays AS (SELECT h.sid, h.s, h.id, count(*) AS m FROM held h JOIN tk t ON t.sid = h.sid AND t.idx = h.node LEFT JOIN held u ON u.sid = h.sid AND u.s = h.s AND u.id = h.id AND u.node = t.head
  WHERE NOT t.letter OR (u.node IS NOT NULL AND t.deprel IN {listed(dependency.LETTER_DEPRELS)}) OR EXISTS (SELECT 1 FROM an a WHERE a.sid = h.sid AND a.idx BETWEEN h.node - 3 AND h.node + 3) GROUP BY h.sid, h.s, h.id)
SELECT h.sid, h.s::BIGINT AS s, h.e::BIGINT AS e, h.id, (CASE WHEN n.n = 1 THEN 1 ELSE coalesce(m, 0) END)::BIGINT AS expanded FROM hd h JOIN n USING (sid, s, id) LEFT JOIN stays USING (sid, s, id)""", base=RECURSIVE)
def h6(spark, sf):
    return expanded(spark, sf, "expanded")


@query("m4_parser_plug_in", "SELECT sid, i::BIGINT AS idx, tok AS text, lower(tok) AS lemma, 'NOUN' AS upos, CASE WHEN i > 0 THEN i - 1 END::BIGINT AS head, 'dep' AS deprel FROM tok")
def m4(spark, sf):
    def parser():
        return lambda text: [(t, t.lower(), "NOUN", None if k == 0 else k - 1, "dep", 0) for k, t in enumerate(text.split())]

    return dependency.parse_texts(sentences(spark, sf).select("sid", "text"), parser).select("sid", *long("idx"), "text", "lemma", "upos", *long("head"), "deprel")


@query("g9_backoff", "SELECT k::BIGINT AS refusals, (k + 1)::BIGINT AS tries, (5 * (2 ** k - 1))::BIGINT AS waited FROM range(5) AS t(k)")
def g9(spark, sf):
    """A generator that refuses a number of times before it answers, and what was waited for it."""
    rows = []
    for refusals in range(5):
        asked, waits = [], []

        def call(prompt: str) -> str:
            asked.append(prompt)
            if len(asked) <= refusals:  # noqa: B023  called at once
                raise RuntimeError("rate")
            return prompt

        corpus.backoff(call, "x", wait=waits.append)
        rows.append((refusals, len(asked), int(sum(waits))))
    return spark.createDataFrame(rows, "refusals bigint, tries bigint, waited bigint")


@query("g6_fewer_variants", "SELECT 1::BIGINT AS variants, count(*) FILTER (len(toks) > 60)::BIGINT AS skipped FROM arr")
def g6(spark, sf):
    """With three variants of each sentence too many exceed the limit, so one is made."""
    def make(variants):
        s = sentences(spark, sf).select("sid", F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n"))
        return s.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants))))

    variants, kept, skipped = corpus.retry_with_fewer(make, F.col("n") <= 60, (3, 1), 0)
    return spark.createDataFrame([(variants, skipped)], "variants bigint, skipped bigint")


@query("h3_subtree_sizes", """WITH nodes AS (SELECT sid, i, CASE WHEN i % 5 = 0 OR i = 1 THEN NULL ELSE i - 1 - i % 2 END AS head FROM tok),
al AS (SELECT sid, i AS node, i AS top FROM nodes UNION SELECT a.sid, a.node, n.head AS top FROM al a JOIN nodes n ON n.sid = a.sid AND n.i = a.top WHERE n.head IS NOT NULL)
SELECT sid, top::BIGINT AS top, count(*)::BIGINT AS size FROM al GROUP BY sid, top""", base=RECURSIVE)
def h3(spark, sf):
    """The subtree closure of whole turns, of any depth."""
    nodes = tokens(spark, sf).select("sid", "i", F.when((F.col("i") % 5 != 0) & (F.col("i") != 1), F.col("i") - 1 - F.col("i") % 2).alias("head"))
    return dependency.subtree_sizes(nodes).select("sid", *long("top"), "size")


@query("h1_mask_alignment")
def h1(spark, sf):
    s = sentences(spark, sf).select("sid", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"), F.lit(0)).alias("tokens"), F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("n"))
    mask = F.when(F.col("n") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.when((k + F.col("sid")) % 4 == 0, "1").otherwise("0")), "")).otherwise("")
    x = align.align_mask(s.withColumn("mask", mask), MATH, ("in", "to"))
    return x.select("sid", F.col("n").cast("bigint").alias("n"), F.coalesce(F.size("aligned"), F.lit(-1)).cast("bigint").alias("n_aligned"))


HASH = "md5(sid || '|' || '42')"


@query("g1_hash_split", f"SELECT sid, CASE WHEN row_number() OVER (ORDER BY {HASH}, sid) <= 50 THEN 'test' ELSE 'val' END AS split FROM sent")
def g1(spark, sf):
    return corpus.hash_split(sentences(spark, sf).select("sid"))


@query("g2_stratified_sample", """WITH n AS (SELECT sid, len(toks) AS n FROM arr), b AS (SELECT *, CASE WHEN n BETWEEN 3 AND 6 THEN 0 WHEN n BETWEEN 7 AND 12 THEN 1 WHEN n BETWEEN 13 AND 18 THEN 2 WHEN n BETWEEN 19 AND 25 THEN 3 END AS bucket FROM n),
p AS (SELECT bucket, CASE bucket WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 WHEN 2 THEN 0.3 ELSE 0.2 END::DOUBLE AS w FROM b WHERE bucket IS NOT NULL GROUP BY bucket),
q AS (SELECT bucket, round(20 * w / (SELECT sum(w) FROM p))::INT AS quota FROM p),
r AS (SELECT b.*, row_number() OVER (PARTITION BY bucket ORDER BY md5(sid || '|' || 's'), sid) AS rank FROM b WHERE bucket IS NOT NULL)
SELECT sid, bucket::BIGINT AS bucket FROM r JOIN q USING (bucket) WHERE rank <= quota""")
def g2(spark, sf):
    from spanspark.functions.text import words

    s = sentences(spark, sf).select("sid", F.size(words(F.col("text"))).alias("n"))
    return corpus.stratified(s, F.col("n"), 20, "sid", "s").select("sid", *long("bucket"))


TEMPLATE = """WITH t AS (SELECT sid, i, tok, tag FROM bio2 WHERE tag IN ('O', 'B-MATH')),
tp AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY i) - 1 AS n, CASE WHEN tag = 'O' THEN tok END AS item, CASE WHEN tag = 'B-MATH' THEN sum((tag = 'B-MATH')::INT) OVER (PARTITION BY sid ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 END AS slot FROM t)"""


@query("g3_template_extraction", TEMPLATE + " SELECT sid, n::BIGINT AS n, item, slot::BIGINT AS slot FROM tp")
def g3(spark, sf):
    return corpus.templates(gold(spark, sf)).select("sid", *long("n"), "item", *long("slot"))


FILLERS = ((0, "ix plus one"), (1, "alpha"), (2, "y minus two"), (3, "sum of a and b"), (4, "zet"))
FILL = ", f(ord, text) AS (VALUES " + ", ".join(f"({k}, '{t}')" for k, t in FILLERS) + ")"


@query("g4_template_injection", TEMPLATE + FILL + r""", v AS (SELECT tp.*, unnest(range(2)) AS variant FROM tp),
h AS (SELECT *, CASE WHEN slot IS NOT NULL THEN ('0x' || left(md5(sid || '|' || variant || '|' || slot), 8))::BIGINT % 5 END AS ord FROM v),
p AS (SELECT h.sid, h.variant, h.n, h.slot, CASE WHEN h.slot IS NULL THEN [h.item] ELSE string_split_regex(f.text, '\s+') END AS parts FROM h LEFT JOIN f USING (ord)),
e AS (SELECT sid, variant, n, slot, unnest(range(len(parts))) AS j, unnest(parts) AS tok FROM p)
SELECT sid, variant::BIGINT AS variant, (row_number() OVER (PARTITION BY sid, variant ORDER BY n, j) - 1)::BIGINT AS i, tok, CASE WHEN slot IS NULL THEN 'O' WHEN j = 0 THEN 'B-MATH' ELSE 'I-MATH' END AS tag FROM e""")
def g4(spark, sf):
    f = spark.createDataFrame(list(FILLERS), "ord bigint, text string")
    return corpus.inject(corpus.templates(gold(spark, sf)), f, 2, len(FILLERS)).select("sid", *long("variant", "i"), "tok", "tag")


CARRIERS = [("Let", "{MATH}", "."), ("We get", "{MATH}", "."), ("{MATH}", ".", ""), ("If", "{MATH}", ", then done .")]


@query("g5_carrier_wrapping", "WITH c(k, prefix, suffix) AS (VALUES (0, 'Let', '.'), (1, 'We get', '.'), (2, '', '.'), (3, 'If', ', then done .'))" + FILL + ", n AS (SELECT unnest(range(22)) AS n), d AS (SELECT n, CASE WHEN n < 6 THEN 0 WHEN n < 12 THEN 1 WHEN n < 17 THEN 2 ELSE 3 END AS k FROM n) SELECT d.n::BIGINT AS n, c.prefix, f.text, c.suffix FROM d JOIN c USING (k) JOIN f ON f.ord = (d.n * 7 + 3) % 5")
def g5(spark, sf):
    f = spark.createDataFrame(list(FILLERS), "ord bigint, text string")
    return corpus.carried(f, CARRIERS, 22, len(FILLERS)).select(*long("n"), "prefix", "text", "suffix")


@query("g7_sample_per_batch", "WITH b AS (SELECT unnest(range(4)) AS batch), r AS (SELECT batch, item_id, row_number() OVER (PARTITION BY batch ORDER BY md5(item_id || '|' || batch), item_id) AS rank FROM b, benchmark) SELECT batch::BIGINT AS batch, item_id FROM r WHERE rank <= 6")
def g7(spark, sf):
    from pyspark.sql import Window

    each = table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("batch"))
    order = Window.partitionBy("batch").orderBy(F.md5(F.concat_ws("|", F.col("item_id").cast("string"), F.col("batch").cast("string"))), "item_id")
    return each.withColumn("rank", F.row_number().over(order)).where("rank <= 6").select(*long("batch"), "item_id")


@query("g8_noise_predictor", f"""WITH d AS (SELECT sid, i, ('0x' || left(md5(sid || '|' || i || '|42'), 8))::BIGINT % 10 AS draw FROM tok),
o AS (SELECT *, last_value(CASE WHEN draw <> 1 THEN draw END IGNORE NULLS) OVER ({RUN} 1 PRECEDING) AS opener FROM d)
SELECT sid, i::BIGINT AS i, CASE WHEN draw = 0 THEN 'B-MATH' WHEN draw = 1 AND coalesce(opener = 0, false) THEN 'I-MATH' ELSE 'O' END AS tag FROM o""")
def g8(spark, sf):
    return models.random_tags(tokens(spark, sf).select("sid", "i")).select("sid", *long("i"), "tag")


@query("m1_transition_counts", "SELECT coalesce(lag, '<s>') AS before, tag, count(*)::BIGINT AS n FROM (SELECT tag, lag(tag) OVER (PARTITION BY sid ORDER BY i) AS lag FROM bio2) GROUP BY 1, 2")
def m1_transitions(spark, sf):
    return models.transitions(gold(spark, sf))


@query("m1_sequence_model")
def m1(spark, sf):
    """A conditional random field fitted on two thirds of the sentences, decoded on the rest."""
    x = bio.context(features.surface(gold(spark, sf).select("sid", "i", "tok", "tag")).select("sid", "i", "tag", "lower", "suffix3", "shape"), ("lower",), (-1, 1))
    model = crf.fit(x.where("sid % 3 <> 0"), ("lower", "suffix3", "shape", "lower_m1", "lower_p1"), iterations=15)
    return crf.decode(model, x.where("sid % 3 = 0")).select("sid", *long("i"), "tag")


GRID = {"words": ("lower",), "words+previous": ("lower", "lower_m1"), "prefix": ("prefix3",)}
GRID_SQL = """WITH x AS (SELECT sid, i, tag, lower(tok) AS lower, left(tok, 3) AS prefix3, coalesce(lag(lower(tok)) OVER (PARTITION BY sid ORDER BY i), 'BOS') AS lower_m1 FROM bio2)"""


def grid_sql(name: str, columns: tuple[str, ...]) -> str:
    c = ", ".join(columns)
    return f"""(WITH n AS (SELECT {c}, tag, count(*) AS n FROM x WHERE sid % 3 <> 0 GROUP BY ALL), b AS (SELECT {c}, arg_min(tag, (-n, tag)) AS best FROM n GROUP BY {c}), p AS (SELECT tag AS g, coalesce(best, 'O') AS p FROM x LEFT JOIN b USING ({c}) WHERE sid % 3 = 0),
s AS (SELECT count(*) FILTER (g <> 'O' AND p <> 'O') AS tp, count(*) FILTER (g = 'O' AND p <> 'O') AS fp, count(*) FILTER (g <> 'O' AND p = 'O') AS fn FROM p) SELECT '{name}' AS config, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1 FROM s)"""


@query("m2_ablation_grid", GRID_SQL + " SELECT * FROM " + " UNION ALL SELECT * FROM ".join(grid_sql(k, c) for k, c in GRID.items()))
def m2(spark, sf):
    """Each set of columns is fitted on two thirds of the sentences and scored on the rest."""
    x = bio.context(features.surface(gold(spark, sf).select("sid", "i", "tok", "tag")).select("sid", "i", "tag", "lower", "prefix3"), ("lower",), (-1,))
    train, test = x.where("sid % 3 <> 0"), x.where("sid % 3 = 0")

    def scored(name, columns):
        s = evaluate.token_scores(test, models.majority_tags(train, test, columns)).first()
        return {k: s[k] for k in ("tp", "fp", "fn", "f1")}

    return spark.createDataFrame(pd.DataFrame(models.run_grid(GRID, scored)), "config string, tp bigint, fp bigint, fn bigint, f1 double")


STAGES = (("noisy", ("val",), 2), ("clean", ("train_clean", "test"), 3))


@query("m6_curriculum", f"WITH x AS (SELECT DISTINCT sid, {SPLIT3} AS split FROM bio2) SELECT 0::BIGINT AS ord, 'noisy' AS stage, NULL::VARCHAR AS init, 2::BIGINT AS epochs, count(*) FILTER (split = 'val')::BIGINT AS sentences FROM x UNION ALL SELECT 1, 'clean', 'noisy', 3, count(*) FILTER (split IN ('train_clean', 'test')) FROM x")
def m6(spark, sf):
    return models.curriculum(gold(spark, sf).withColumn("split", split3()), STAGES)


@query("m3_tagger_default", "SELECT sid, i::BIGINT AS i, tok, 'UNK' AS postag FROM tok")
def m3(spark, sf):
    from spanspark.functions.text import words

    return models.tag_words(sentences(spark, sf).select("sid", words(F.col("text")).alias("toks"))).select("sid", *long("i"), "tok", "postag")


@query("m8_padding", "WITH b AS (SELECT sid, sid % 16 AS batch, len(toks) AS n FROM arr) SELECT sid, n::BIGINT AS n, (max(n) OVER (PARTITION BY batch))::BIGINT AS padded FROM b")
def m8(spark, sf):
    from spanspark.functions.text import words

    s = sentences(spark, sf).select("sid", F.transform(words(F.col("text")), lambda w: F.length(w)).alias("x"), F.size(words(F.col("text"))).cast("bigint").alias("n"))
    return models.padded(s, "x", F.col("sid") % 16).select("sid", "n", F.size("x").cast("bigint").alias("padded"))
