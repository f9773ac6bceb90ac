"""Quality rules as a short-circuit cascade, with DataFrame functions only.

A rule is a named condition that rejects a text. Cost (seconds) and selectivity (share rejected) of each rule are
estimated on a sample; the rules then stand in one CASE expression in the order of rejections per cost, so a text that
a cheap rule rejects never reaches a dear one. The order changes the speed only: a text is kept if no rule rejects it.
A rule's cost is the time by which a job that applies it to the sample, taken many times over, exceeds the same job
without a rule, so starting a job doesn't count. A text is split into words once: what several rules need is bound to a
lambda's variable, which no optimiser copies. ``verdict`` is the cascade; ``measure`` reports every measure of every
text, so there only the added rules' own conditions are passed over.

Defined results: null text has no words; very long texts are measured whole; rules of equal gain keep their listed
order; repeated rows and null ids give one row each; an empty table gives no rows and the rules keep their listed order;
other columns pass through ``verdict`` and are ignored by ``measure``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanspark.llm.common import checkpointed, text_of

#: Rows that the estimates look at, and the longest text among them; verdicts never depend on either.
SAMPLE_ROWS, SAMPLE_BYTES = 200, 20_000
#: How many times over a timed job takes the sample, and how often it runs; the fastest counts.
TIMES_OVER, TIMED_RUNS = 10, 2
BLANK_CHARS = " \\t\\n\\u000b\\u000c\\r"
SYMBOLS = "#*$%&|<>"

#: SQL over a text {t}, or over its words {ws}.
WORDS = r"filter(split({t}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"
WORD_CHARS = f"length(translate({{t}}, '{BLANK_CHARS}', ''))"
N_SYMBOLS = f"(length({{t}}) - length(translate({{t}}, '{SYMBOLS}', '')))"
#: Lines with a word that equal an earlier line.
N_DUP_LINES = r"transform(array(filter(split({t}, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')), ls -> size(ls) - size(array_distinct(ls)))[0]"


def repeat_words(ws: str) -> str:
    """SQL: words inside a three-word window that the words ws hold twice or more.

    A text whose windows all have different hashes repeats none. Else all windows are sorted by hash, words and place;
    equal neighbours are the repeated windows, and the distinct places they cover are counted. Exact, and linear in the
    text but for the sort, whatever the text repeats.
    """
    repeated = """transform(array(sort_array(transform(hs, (h, i) -> struct(h as h, concat_ws(' ', WS[i], WS[i + 1], WS[i + 2]) as w, i as i)))), ss ->
        transform(filter(ss, (x, k) -> (k > 0 and ss[greatest(k - 1, 0)].h = x.h and ss[greatest(k - 1, 0)].w = x.w)
            or (k < size(ss) - 1 and ss[least(k + 1, size(ss) - 1)].h = x.h and ss[least(k + 1, size(ss) - 1)].w = x.w)), x -> x.i))[0]""".replace("WS", ws)
    covered = "size(array_distinct(flatten(array(ps, transform(ps, p -> p + 1), transform(ps, p -> p + 2)))))"
    return f"""(case when size({ws}) < 3 then 0 else
        transform(array(transform(sequence(0, size({ws}) - 3), i -> xxhash64({ws}[i], {ws}[i + 1], {ws}[i + 2]))), hs ->
            case when size(array_distinct(hs)) = size(hs) then 0
              else transform(array({repeated}), ps -> {covered})[0] end)[0] end)"""


#: The two base rules: n words, r of them in repeated windows.
BASE_RULES = {"too_few_words": "{n} < 50", "repetitive": "100 * {r} > 50 * {n}"}
#: Rules beyond the base, over words n, their characters c, symbols s, repeated lines d and the text t; each leaves ordinary prose far from its threshold.
ADDED_RULES = {
    "symbols": "100 * {s} > 8 * {c}",
    "shouting": r"(length({t}) - length(regexp_replace({t}, '[^\\p{{Lu}}]+', ''))) / greatest(1, {c}) < 0.6",
    "word_length": "({c} < 2 * {n} or {c} > 14 * {n})",
    "repeated_lines": r"2 * {d} > size(split({t}, '\n'))",
    "exclaiming": "4 * (length({t}) - length(replace({t}, '!', ''))) > {n}",
}
RULES = BASE_RULES | ADDED_RULES


def bound(body: str, t: str) -> str:
    """SQL of body, in which m.ws, m.c and m.s are the words of the text t, their characters and its symbols, each computed once."""
    return f"transform(array(named_struct('ws', {WORDS.format(t=t)}, 'c', {WORD_CHARS.format(t=t)}, 's', {N_SYMBOLS.format(t=t)})), m -> {body})[0]"


def condition(rule: str, t: str) -> str:
    """SQL of a rule inside bound()."""
    return RULES[rule].format(n="size(m.ws)", c="m.c", s="m.s", d=N_DUP_LINES.format(t=t), r=repeat_words("m.ws"), t=t)


def cascade_order(docs: DataFrame, rules: Sequence[str] = tuple(RULES), sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by estimated rejections per second, the best first, from sample_rows rows of docs(whole)."""
    first = docs.select("whole").where(F.octet_length("whole") <= SAMPLE_BYTES).take(sample_rows)  # reads no more partitions than it needs
    if not first:
        return list(rules)
    given = checkpointed(docs.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*(F.lit(r.whole) for r in first))).alias("whole")))
    sample = given.select("whole", F.explode(F.sequence(F.lit(1), F.lit(TIMES_OVER))).alias("time")).select("whole")

    def timed(rejects: str) -> tuple[int, float]:
        seconds = []
        for _ in range(TIMED_RUNS):
            began = time.perf_counter()
            gone = sample.where(F.expr(rejects)).count()
            seconds.append(time.perf_counter() - began)
        return gone, min(seconds)

    _, empty = timed("length(whole) < 0")
    gain = {}
    for name in rules:
        gone, seconds = timed(bound(condition(name, "whole"), "whole"))
        gain[name] = gone / max(1e-4, seconds - empty)
    return sorted(rules, key=lambda k: -gain[k])


def cascade(order: Sequence[str], t: str = "whole") -> Column:
    """The first rule in order that rejects the text t; null: the text is kept."""
    return F.expr(bound("case " + " ".join(f"when {condition(name, t)} then '{name}'" for name in order) + " end", t))


def verdict(docs: DataFrame, text: str = "text") -> Column:
    """For rows of docs the first rule that rejects the text, null if it is kept; no costly measure is computed in vain."""
    return cascade(cascade_order(docs.select(text_of(text).alias("whole"))), f"coalesce(cast(`{text}` as string), '')")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept for each row of docs(doc_id, text)."""
    whole = docs.select("doc_id", text_of().alias("whole"))
    order = cascade_order(whole)
    measures = {"n_words": "size(m.ws)", "word_chars": "m.c", "n_symbols": "m.s", "n_dup_lines": N_DUP_LINES.format(t="whole"), "n_repeat_words": repeat_words("m.ws")}
    all_of = bound("named_struct(" + ", ".join(f"'{k}', cast({v} as bigint)" for k, v in measures.items()) + ")", "whole")
    verdicts = {k: RULES[k].format(n="m.n_words", c="m.word_chars", s="m.n_symbols", d="m.n_dup_lines", r="m.n_repeat_words", t="whole") for k in order}
    failed = " or ".join(verdicts[k] for k in order if k in BASE_RULES)
    rejected = "case " + " ".join(f"when {verdicts[k]} then '{k}'" for k in order) + " end"
    judged = F.expr(f"transform(array({all_of}), m -> named_struct('m', m, 'base_failed', {failed}, 'rejected_by', {rejected}))[0]")
    return whole.select("doc_id", judged.alias("j")).select("doc_id", "j.m.*", "j.base_failed", F.col("j.rejected_by").isNull().alias("kept"))
