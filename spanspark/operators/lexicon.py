"""Lexicon entries over token sequences: candidate join, regex entries, greedy choice, clusters, merges, and the lexical detector.

words: (sid, i, tok) with i counting words only, and lemma where there is one. lexicon: (ord, id, pattern, role,
match_type, confidence); ord is the lexicon's order, which settles ties. Phrase, exact and lemma candidates come from an
equi-join of n-grams no longer than the longest pattern with the lexicon, which is counted: it is broadcast up to
``MOST_BROADCAST`` patterns and shuffled beyond; n-grams are never broadcast. Regex entries (at most ``MAX_REGEXES``, collected from the lexicon) are searched in a sentence's normalised words joined by
blanks. Choosing among overlapping candidates depends on order and is done sentence by sentence as sentences stream by.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanspark.functions.text import normal_token, phrase_tokens
from spanspark.storage import bound_batches, one_by_one, sent

# Role classes and limits.
BOUNDARY_ROLES = ("NEGATIVE_CONTEXT", "BOUNDARY", "BOUNDARY_AMBIGUOUS", "END_CONTEXT", "DISCOURSE_START")
POSITIVE_ROLES = ("RELATION", "OPERATOR", "STRUCTURE", "OBJECT", "VARIABLE", "CONSTANT", "QUANTIFIER", "CONNECTIVE")
TOPIC_ROLES = ("OBJECT", "VARIABLE", "CONNECTIVE")
TOPIC_PREPOSITIONS = ("про", "о", "об")
ADVERSATIVES = ("а", "но", "однако", "зато")
NON_VARIABLE_UPOS = ("ADP", "CCONJ", "SCONJ", "PART", "PRON")
LEADING_UPOS = ("ADP", "SCONJ", "PART", "CCONJ")
CLUSTER_GAP, MERGE_GAP, NEAR = 3, 2, 3
MAX_REGEXES, MOST_BROADCAST = 10_000, 100_000
MATCH = "sid bigint, s int, e int, role string, id string, ord int"


def patterns(lexicon: DataFrame) -> DataFrame:
    """lexicon's phrase, exact and lemma entries with their key (normalised tokens joined) and size; empty patterns fall away."""
    own = lexicon.where(F.col("match_type").isin("phrase", "exact", "lemma")).withColumn("parts", phrase_tokens(F.col("pattern")))
    return own.withColumn("key", F.array_join("parts", " ")).withColumn("size", F.size("parts")).where("size > 0").drop("parts")


def counted(patterns_: DataFrame) -> DataFrame:
    """patterns_ with the join that their number allows. Left to itself the planner, which knows no size of a lexicon and takes
    the n-grams for as small as the compressed file of their texts, broadcasts the n-grams."""
    return F.broadcast(patterns_) if patterns_.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else patterns_.hint("merge")


def candidates(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(sid, s, e, role, id, ord) of every place a pattern matches: lemma entries by words' lemmas, others by the words.

    A missing lemma is the word itself; words without a lemma column are their own lemmas.
    """
    order = Window.partitionBy("sid").orderBy("i")
    series = {"word": F.col("tok")} | ({"lemma": F.coalesce("lemma", "tok")} if "lemma" in words.columns else {})
    w = words.select("sid", "i", *(normal_token(c).alias(f"{k}1") for k, c in series.items()))
    for n in range(2, longest + 1):
        w = w.select("*", *(F.lead(f"{k}1", n - 1).over(order).alias(f"{k}{n}") for k in series))
    grams = [F.struct(F.lit(k).alias("by"), F.lit(n).cast("int").alias("size"), F.concat_ws(" ", *(f"{k}{m}" for m in range(1, n + 1))).alias("key"), F.col(f"{k}{n}").isNotNull().alias("ok")) for k in series for n in range(1, longest + 1)]
    each = w.select("sid", "i", F.explode(F.array(*grams)).alias("g")).where("g.ok").select("sid", "i", "g.by", "g.size", "g.key")
    by = F.when(F.col("match_type") == "lemma", list(series)[-1]).otherwise("word")
    found = each.join(counted(patterns(lexicon).select("ord", "id", "role", "size", "key", by.alias("by"))), ["by", "size", "key"])
    return found.select("sid", F.col("i").cast("int").alias("s"), (F.col("i") + F.col("size")).cast("int").alias("e"), "role", "id", "ord")


def regex_entries(lexicon: DataFrame) -> list[tuple[int, str, str, str]]:
    """(ord, id, pattern, role) of the regex entries in the lexicon's order."""
    rows = lexicon.where(F.col("match_type") == "regex").select("ord", "id", "pattern", "role").orderBy("ord").limit(MAX_REGEXES + 1).collect()
    if len(rows) > MAX_REGEXES:
        raise ValueError(f"more than {MAX_REGEXES} regex entries")
    return [tuple(r) for r in rows]


def regex_matches(forms: Sequence[str], entries: Iterable[tuple]) -> Iterator[tuple[int, int, str, str, int]]:
    """(s, e, role, id, ord) of regex entries (ord, id, compiled pattern, role), each from left to right without overlaps.

    A match counts if it starts where a word starts and ends where one ends.
    """
    line = " ".join(forms)
    starts, ends, at = {}, {}, 0
    for k, form in enumerate(forms):
        starts.setdefault(at, k)
        at += len(form)
        ends.setdefault(at, k + 1)
        at += 1
    for order, ident, pattern, role in entries:
        for m in pattern.finditer(line):
            s, e = starts.get(m.start()), ends.get(m.end())
            if s is not None and e is not None and s < e:
                yield s, e, role, ident, order


def choose(found: Iterable[tuple], forms: Sequence[str] = (), regexes: Iterable[tuple] = ()) -> list[tuple]:
    """The matches (s, e, role, id, ord) that stay: longer ones first, then by the lexicon's order, then by place.

    A class (boundary roles or not) blocks itself only. Regex matches come last; those of boundary roles block nothing
    and are never blocked.
    """
    taken: dict[bool, set[int]] = {True: set(), False: set()}
    kept = []
    for m in sorted(found, key=lambda m: (m[0] - m[1], m[4], m[0])):
        mine = taken[m[2] in BOUNDARY_ROLES]
        if mine.isdisjoint(range(m[0], m[1])):
            mine.update(range(m[0], m[1]))
            kept.append(m)
    for m in regex_matches(forms, regexes) if regexes else ():
        if m[2] in BOUNDARY_ROLES:
            kept.append(m)
        elif taken[False].isdisjoint(range(m[0], m[1])):
            taken[False].update(range(m[0], m[1]))
            kept.append(m)
    return kept


def chosen(sentences: DataFrame, regexes: Sequence[tuple[int, str, str, str]] = ()) -> DataFrame:
    """The matches that stay of sentences(sid, found, forms): candidates and normalised words of a sentence."""
    names = [x.split()[0] for x in MATCH.split(", ")]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(o, i, re.compile(p, re.IGNORECASE), r) for o, i, p, r in regexes]
        rows = ((sid, *m) for sid, found, forms in one_by_one(batches, "sid", "found", "forms") for m in choose([(m["s"], m["e"], m["role"], m["id"], m["ord"]) for m in found or ()], forms or (), compiled))
        return sent(rows, names, types)

    return bound_batches(sentences).mapInArrow(each, MATCH)


def gathered(found: DataFrame) -> DataFrame:
    return found.groupBy("sid").agg(F.collect_list(F.struct("s", "e", "role", "id", "ord")).alias("found"))


def joined_forms(words: DataFrame) -> DataFrame:
    """(sid, forms): a sentence's normalised words in order."""
    each = F.sort_array(F.collect_list(F.struct("i", normal_token(F.col("tok")).alias("w"))))
    return words.groupBy("sid").agg(F.transform(each, lambda x: x["w"]).alias("forms"))


def resolve(found: DataFrame) -> DataFrame:
    """Greedy choice among candidates of phrase, exact and lemma entries."""
    return chosen(gathered(found).withColumn("forms", F.expr("cast(array() as array<string>)")))


def matches(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(sid, s, e, role, id, ord): all entries' matches that stay."""
    found, regexes = candidates(words, lexicon, longest), regex_entries(lexicon)
    return chosen(joined_forms(words).join(gathered(found).hint("merge"), "sid", "left"), regexes) if regexes else resolve(found)


def regex_spans(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(sid, s, e, role, id, ord) of the regex entries alone, leftmost first, at word bounds."""
    none = F.expr("cast(array() as array<struct<s:int,e:int,role:string,id:string,ord:int>>)")
    return chosen(joined_forms(words).withColumn("found", none), regex_entries(lexicon))


def drop_spoken_variables(matches: DataFrame, words: DataFrame) -> DataFrame:
    """VARIABLE matches none of whose words is a function word; words: (sid, i, upos).

    No join is broadcast: words and matches outgrow the size that a scan of their texts lets expect.
    """
    bad = words.where(F.col("upos").isin(*NON_VARIABLE_UPOS)).select("sid", "i")
    hit = matches.where("role = 'VARIABLE'").select("sid", "s", "e", "id", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("i")).join(bad.hint("merge"), ["sid", "i"], "left_semi").select("sid", "s", "e", "id").distinct()
    return matches.join(hit.hint("merge"), ["sid", "s", "e", "id"], "left_anti")


def near_anchor(letters: DataFrame, anchors: DataFrame, distance: int = NEAR) -> DataFrame:
    """letters (sid, i) with an anchor index at most distance away, by the nearest anchor on either side."""
    both = letters.select("sid", "i", F.lit(False).alias("anchor")).unionByName(anchors.select("sid", "i", F.lit(True).alias("anchor")))
    order = Window.partitionBy("sid").orderBy("i")
    at = F.when(F.col("anchor"), F.col("i"))
    back = F.last(at, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first(at, ignorenulls=True).over(order.rangeBetween(0, Window.unboundedFollowing))
    near = both.withColumn("back", back).withColumn("ahead", ahead).where("not anchor")
    return near.where((F.col("i") - F.col("back") <= distance) | (F.col("ahead") - F.col("i") <= distance)).select("sid", "i")


def clusters(anchors: DataFrame, gap: int = CLUSTER_GAP, within: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(within…, s, e, n, roles): hulls of anchors (not connectives) that lie at most gap apart."""
    order = Window.partitionBy(*within).orderBy("s", "e", "id")
    x = anchors.where("role <> 'CONNECTIVE'").withColumn("pe", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("k", F.sum(F.coalesce((F.col("s") - F.col("pe") > gap).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*within, "k").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles")).drop("k")


def blockers(words: DataFrame) -> DataFrame:
    """(sid, i, cut): running count of words that end a sentence or oppose, up to and with word i."""
    cut = F.col("tok").rlike(r"[.?!;:]\s*$") | normal_token(F.col("tok")).isin(*ADVERSATIVES)
    return words.select("sid", "i", F.sum(cut.cast("int")).over(Window.partitionBy("sid").orderBy("i")).alias("cut"))


def merge(spans: DataFrame, words: DataFrame, gap: int = MERGE_GAP) -> DataFrame:
    """(sid, s, e, k): spans joined where they overlap, or lie at most gap apart with nothing that blocks between.

    The end of the joined span so far is the running maximum of ends, so one window decides.
    """
    order = Window.partitionBy("sid").orderBy("s", "e")
    x = spans.withColumn("pe", F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    cuts = blockers(words)
    x = x.withColumn("left_at", F.col("pe") - 1).withColumn("right_at", F.col("s") - 1)
    x = x.join(cuts.select("sid", F.col("i").alias("left_at"), F.col("cut").alias("cl")), ["sid", "left_at"], "left").join(cuts.select("sid", F.col("i").alias("right_at"), F.col("cut").alias("cr")), ["sid", "right_at"], "left")
    last_cuts = F.col("cr") - F.col("cl")
    ends = words.select("sid", F.col("i").alias("left_at"), F.col("tok").rlike(r"[.?!;:]\s*$").alias("ends"))
    x = x.join(ends, ["sid", "left_at"], "left")
    joined = F.col("pe").isNotNull() & ((F.col("pe") > F.col("s")) | ((F.col("s") - F.col("pe") <= gap) & (last_cuts == 0) & ~F.col("ends")))
    x = x.withColumn("k", F.sum((~F.coalesce(joined, F.lit(False))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy("sid", "k").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def previous_word(spans: DataFrame, words: DataFrame) -> DataFrame:
    """spans with prev, the normalised word before their start (null at a sentence's start)."""
    before = words.select("sid", (F.col("i") + 1).alias("s"), normal_token(F.col("tok")).alias("prev"))
    return spans.join(before.hint("merge"), ["sid", "s"], "left")


def suppress(spans: DataFrame, words: DataFrame, prepositions: tuple[str, ...] = TOPIC_PREPOSITIONS) -> DataFrame:
    """spans (with roles) but those of connectives only, and topics that a preposition introduces."""
    roles = F.split("roles", ",")
    only = lambda allowed: F.forall(roles, lambda r: r.isin(*allowed))
    drop = only(("CONNECTIVE",)) | (only(TOPIC_ROLES) & F.coalesce(F.col("prev").isin(*prepositions), F.lit(False)))
    return previous_word(spans, words).where(~drop).drop("prev")


def prefix_until_break(kept: DataFrame, words: DataFrame) -> DataFrame:
    """Per span (sid, span) its kept indices up to the first sentence end that lies between two of them."""
    ends = words.select("sid", "i", F.sum(F.col("tok").rlike(r"[.?!;:]\s*$").cast("int")).over(Window.partitionBy("sid").orderBy("i")).alias("c"), F.col("tok").rlike(r"[.?!;:]\s*$").cast("int").alias("own"))
    first = Window.partitionBy("sid", "span").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = kept.join(ends, ["sid", "i"]).withColumn("c0", F.first("c").over(first)).withColumn("own0", F.first("own").over(first))
    return x.where(F.col("c") - F.col("own") - F.col("c0") + F.col("own0") == 0).select("sid", "span", "i")


def trim_leading(kept: DataFrame) -> DataFrame:
    """Per span its indices (sid, span, i, upos, anchor) without leading function words that aren't anchors; one stays."""
    order = Window.partitionBy("sid", "span")
    holds = F.min(F.when(F.col("anchor") | ~F.col("upos").isin(*LEADING_UPOS), F.col("i"))).over(order)
    return kept.withColumn("first", F.coalesce(holds, F.max("i").over(order))).where(F.col("i") >= F.col("first")).drop("first")


def detect_lexical(words: DataFrame, lexicon: DataFrame, longest: int) -> DataFrame:
    """(sid, s, e, roles) by lexicon alone: matches, gap clusters, context suppression. No dependency tree is used."""
    found = matches(words, lexicon, longest)
    return suppress(clusters(found.where(F.col("role").isin(*POSITIVE_ROLES))), words)
