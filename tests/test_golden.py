"""Hand-derived cases of the operators' rules."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanspark.functions import text as T
from spanspark.operators import align, bio, corpus, dependency, evaluate, features, lexicon, models
from spanspark.sources import readers, sinks

B, I, O = "B-MATH", "I-MATH", "O"  # noqa: E741
SHORT = {"B": B, "I": I, "O": O}


def tagged(spark, *sentences):
    """Sentences as strings of B, I and O, or lists of (token, tag)."""
    rows = []
    for sid, s in enumerate(sentences):
        for i, x in enumerate(s):
            tok, tag = x if isinstance(x, tuple) else (f"w{i}", x)
            rows.append((sid, i, tok, SHORT.get(tag, tag)))
    return spark.createDataFrame(rows, "sid bigint, i int, tok string, tag string")


def line(df, column="tag", sid=0):
    return [r[column] for r in df.where(F.col("sid") == sid).orderBy("i").collect()]


def tagged_line(spark, text):
    df = bio.parse_tagged(spark.createDataFrame([(0, text)], "sid bigint, text string"))
    return [(r.tok, r.tag) for r in df.orderBy("i").collect()]


def test_parse_tagged(spark):
    got = tagged_line(spark, "Пусть [MATH]икс плюс один[/MATH] , тогда [MATH]V[/MATH] .")
    assert got == [("Пусть", O), ("икс", B), ("плюс", I), ("один", I), (",", O), ("тогда", O), ("V", B), (".", O)]
    assert tagged_line(spark, "[MATH]a[/MATH][MATH]b[/MATH]") == [("a", B), ("b", B)]


def test_punct_outside(spark):
    assert line(bio.punct_outside(tagged(spark, [("a", "B"), (",", "I"), ("b", "I")]))) == [B, O, B]
    assert line(bio.punct_outside(tagged(spark, [(".", "B"), ("x", "I"), ("y", "I")]))) == [O, B, I]


@pytest.mark.parametrize(("text", "reason"), [("[MATH]a[/MATH] [MATH]b", "counts"), ("без тегов", "counts"), ("[/MATH]a[MATH]", "nesting"), ("[MATH]a[MATH]b[/MATH][/MATH]", "nesting"), ("[MATH]a[/MATH] спаны", "leak"), ("[MATH]a[/MATH] СПАН", "leak"), ("[MATH]a[/MATH] ok", None)])
def test_reject_reason(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(T.reject_reason(F.col("t"))).first()[0] == reason


def test_gap_merge(spark):
    toks = "x a b y . z u v w q".split()
    df = spark.createDataFrame([(0, i, t, i in (0, 3, 5, 9)) for i, t in enumerate(toks)], "sid bigint, i int, tok string, math boolean")
    assert sorted((r.s, r.e) for r in bio.gap_spans(df).collect()) == [(0, 4), (5, 6), (9, 10)]
    assert line(bio.gap_merge(df)) == [B, I, I, I, O, B, O, O, O, B]
    assert sorted((r.s, r.e) for r in bio.gap_spans(df, 0).collect()) == [(0, 1), (3, 4), (5, 6), (9, 10)]


def test_spans_strict_and_lenient(spark):
    df = tagged(spark, "OIBIOIIBB")
    assert sorted((r.s, r.e) for r in bio.spans(df).collect()) == [(2, 4), (7, 8), (8, 9)]
    assert sorted((r.s, r.e) for r in bio.spans(df, lenient=True).collect()) == [(1, 2), (2, 4), (5, 7), (7, 8), (8, 9)]


def test_mask_to_bio(spark):
    df = spark.createDataFrame([(0, i, int(b)) for i, b in enumerate("01101")], "sid bigint, i int, bit int")
    assert line(bio.mask_to_bio(df)) == [O, B, I, O, B]


def test_resample_mask_rounds_half_to_even(spark):
    df = spark.createDataFrame([(2, "10100"), (4, "1"), (0, "11"), (3, "")], "n int, m string")
    assert [r[0] for r in df.select(T.resample_mask(F.col("n"), F.col("m"))).collect()] == ["00", "0010", "", "000"]


def test_pooled_and_keyed_scores(spark):
    gold, pred = tagged(spark, "BIO", "OBO"), tagged(spark, "OBO", "BIO")
    assert evaluate.span_scores(gold, pred, pooled=True).first().f1 == 1.0
    assert evaluate.span_scores(gold, pred).first().f1 == 0.0
    t = evaluate.token_scores(gold, pred).first()
    assert (t.tp, t.fp, t.fn, t.tn, t.f1) == (2, 1, 1, 2, 0.666667)
    assert evaluate.exact_match(gold, pred).first().exact_match == 0.0


def test_perfect_and_empty_predictions(spark):
    rng = random.Random(42)
    gold = tagged(spark, *("".join(rng.choice("OOBI") for _ in range(12)) for _ in range(20)))
    same = evaluate.report(gold, gold).first()
    assert (same.span_f1, same.token_f1, same.exact_match) == (1.0, 1.0, 1.0)
    none = gold.withColumn("tag", F.lit(O))
    assert evaluate.token_scores(gold, none).first().recall == 0.0
    assert evaluate.span_scores(gold, none).first().f1 == 0.0


def test_round_trip_and_partition_invariance(spark):
    rng = random.Random(7)
    valid = []
    for _ in range(30):
        s, last = "", "O"
        for _ in range(15):
            last = rng.choice("OB" if last == "O" else "OBI")
            s += last
        valid.append(s)
    df = tagged(spark, *valid)
    painted = bio.paint(bio.spans(df), df.drop("tag"))
    for parts in (1, 7):
        again = bio.paint(bio.spans(df.repartition(parts)), df.drop("tag"))
        assert sorted(map(tuple, painted.select("sid", "i", "tag").collect())) == sorted(map(tuple, again.select("sid", "i", "tag").collect())) == sorted(map(tuple, df.select("sid", "i", "tag").collect()))


def test_span_count_falls_with_gap(spark):
    rng = random.Random(3)
    df = spark.createDataFrame([(s, i, rng.choice(["a", "b", "c."]), rng.random() < 0.4) for s in range(20) for i in range(20)], "sid bigint, i int, tok string, math boolean")
    n = [bio.gap_spans(df, g).count() for g in range(4)]
    assert n == sorted(n, reverse=True)


def test_role_pick(spark):
    df = spark.createDataFrame([("w", "RELATION", 2), ("w", "OPERATOR", 3), ("w", "CONSTANT", 3)], "word string, role string, conf int")
    assert features.best_role(df).first().role == "CONSTANT"


def test_word_functions(spark):
    df = spark.createDataFrame([("Ab9-Ё", "«альфа-1,", "Ёж")], "a string, b string, c string")
    r = df.select(T.word_shape(F.col("a")), T.clean_word(F.col("b")), T.normal_token(F.col("b")), T.clean_word(F.col("c")), T.normal_token(F.col("c"))).first()
    assert tuple(r) == ("Xxd-X", "альфа-1", "альфа1", "ёж", "еж")


def test_context(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (0, 2, "c"), (1, 0, "a")], "sid bigint, i int, x string")
    r = bio.context(df, ("x",)).where("i = 0").orderBy("sid").collect()
    assert [(x.x_m2, x.x_m1, x.x_p1, x.x_p2) for x in r] == [("BOS", "BOS", "b", "c"), ("BOS", "BOS", "EOS", "EOS")]


def test_char_votes(spark):
    ours = spark.createDataFrame([(0, i, t) for i, t in enumerate(["f(x)", "=2", "—"])], "sid bigint, i int, tok string")
    other = spark.createDataFrame([(0, i, t) for i, t in enumerate(["f", "x", "2"])], "sid bigint, i int, tok string")
    assert line(align.char_votes(ours, other), "j") == [0, 2, None]


def test_response_formulas(spark):
    block = "SENTENCE: <F2>б</F2> и <F1>а</F1>\nF1: `x`"
    df = spark.createDataFrame([(block,), ("SENTENCE: <F12>a</F12> <F3>b</F3>\nF3: old\nF3: new\n",), ("SENTENCE: none",)], "b string")
    got = [[tuple(x) for x in r.f] for r in df.select(T.response_formulas(F.col("b")).alias("f")).collect()]
    assert got == [[(1, "а", "x"), (2, "б", "???")], [(3, "b", "new"), (12, "a", "???")], []]
    assert df.select(T.response_tagged(T.response_sentence(F.col("b")))).first()[0] == "[MATH]б[/MATH] и [MATH]а[/MATH]"


LEX = "ord int, id string, pattern string, role string, match_type string, confidence string"


def test_longest_phrase_wins(spark):
    lex = spark.createDataFrame([(0, "a", "больше", "RELATION", "phrase", "high"), (1, "b", "больше или равно", "RELATION", "phrase", "high"), (2, "c", "икс", "BOUNDARY", "phrase", "high"), (3, "d", "икс больше", "OBJECT", "phrase", "low")], LEX)
    words = spark.createDataFrame([(0, i, t) for i, t in enumerate("икс больше или равно ноль".split())], "sid bigint, i int, tok string")
    got = sorted((r.s, r.e, r.id) for r in lexicon.resolve(lexicon.candidates(words, lex, 3)).collect())
    assert got == [(0, 1, "c"), (1, 4, "b")]


def test_clusters(spark):
    a = spark.createDataFrame([(0, 0, 1, "RELATION", "a"), (0, 4, 5, "OBJECT", "b"), (0, 9, 10, "OBJECT", "c"), (0, 7, 8, "CONNECTIVE", "d")], "sid bigint, s int, e int, role string, id string")
    assert sorted((r.s, r.e) for r in lexicon.clusters(a).collect()) == [(0, 5), (9, 10)]


def plain_merge(toks, spans):
    out = []
    for s, e in sorted(spans):
        if out:
            a, b = out[-1]
            between = toks[b:s]
            stop = any(t[-1:] in ".?!;:" for t in toks[b - 1 : s] if t)
            if b > s or (s - b <= 2 and not stop and not any(T_norm(t) in ("а", "но", "однако", "зато") for t in between)):
                out[-1] = (a, max(b, e))
                continue
        out.append((s, e))
    return out


def T_norm(t):
    return dependency.normal(t)


def test_merge_equals_a_loop(spark):
    rng = random.Random(5)
    sents, spans, expected = [], [], []
    for sid in range(40):
        toks = [rng.choice(["a", "b", "но", "c.", "d;"]) for _ in range(15)]
        own = sorted({(s := rng.randrange(14), min(15, s + rng.randint(1, 3))) for _ in range(5)})
        sents += [(sid, i, t) for i, t in enumerate(toks)]
        spans += [(sid, s, e) for s, e in own]
        expected += [(sid, s, e) for s, e in plain_merge(toks, own)]
    got = lexicon.merge(spark.createDataFrame(spans, "sid bigint, s int, e int"), spark.createDataFrame(sents, "sid bigint, i int, tok string"))
    assert sorted((r.sid, r.s, r.e) for r in got.collect()) == sorted(expected)


def test_carrier_counts():
    n = corpus.carrier_counts(16, 520)
    assert n[:8] == [33] * 8 and n[8:] == [32] * 8


def test_over_seeds(spark):
    df = spark.createDataFrame([("b4", v) for v in (0.3333, 0.3514, 0.3013)], "config string, value double")
    r = evaluate.over_seeds(df).first()
    assert (round(r["mean"], 4), round(r["std"], 4)) == (0.3287, 0.0207)


def test_violations(spark):
    assert sorted((r.sid, r.i) for r in bio.violations(tagged(spark, "IO", "BIOI", "OBI")).collect()) == [(0, 0), (1, 3)]


@pytest.mark.parametrize(("text", "drop"), [('title: "x"', True), ('"HTTPS://y', True), (None, True), ("Вспомним", False)])
def test_metadata(spark, text, drop):
    assert spark.createDataFrame([(text,)], "t string").select(T.is_metadata(F.col("t"))).first()[0] is drop


def test_side_defaults_and_last_wins(spark):
    tokens = spark.createDataFrame([(0, 0), (0, 1)], "sid bigint, i int")
    side = spark.createDataFrame([(0, 0, "x", "O", 0), (0, 0, " ", B, 1)], "sid bigint, i int, dep string, rule_tag string, row_no bigint")
    assert sorted(map(tuple, features.with_side(tokens, side).collect())) == [(0, 0, "UNK", B), (0, 1, "UNK", O)]


def test_safe_id(spark):
    df = spark.createDataFrame([("  лек ция!!1 ",), ("***",)], "t string")
    assert [r[0] for r in df.select(T.safe_id(F.col("t"))).collect()] == ["лек_ция_1", "input"]


def test_mask_alignment(spark):
    words, zero = frozenset({"икс"}), frozenset({"и"})
    assert align.fit_mask(["икс", ",", "да"], "10", words, zero) == ["икс,", "да"]
    assert align.fit_mask(["2", "y", "да"], "10", words, zero) == ["2y", "да"]
    assert align.fit_mask(["a"], "10", words, zero) is None
    assert align.fit_mask(["a", "b", "c"], "1", words, zero) is None
    df = spark.createDataFrame([(0, ["икс", ",", "да"], "10"), (1, ["a"], "11"), (2, None, "1")], "sid bigint, tokens array<string>, mask string")
    assert [r.aligned for r in align.align_mask(df, ("икс",), ("и",)).orderBy("sid").collect()] == [["икс,", "да"], None, None]


def parse(spark, *rows):
    return spark.createDataFrame([(0, k, t, t.lower(), u, h, d, 0) for k, (t, u, h, d) in enumerate(rows)], "sid bigint, idx int, text string, lemma string, upos string, head int, deprel string, sent int")


def test_dependency_detector(spark):
    lex = [(0, "a", "икс", "VARIABLE", "phrase"), (1, "b", "плюс", "OPERATOR", "phrase"), (2, "c", "значит", "DISCOURSE_START", "phrase"), (3, "d", "интеграл", "OBJECT", "phrase")]
    rows = [("Значит", "ADV", 2, "advmod"), (",", "PUNCT", 0, "punct"), ("икс", "NOUN", None, "root"), ("плюс", "NOUN", 2, "nmod"), ("один", "NUM", 3, "nmod"), (".", "PUNCT", 2, "punct"), ("Поговорим", "VERB", None, "root"), ("про", "ADP", 8, "case"), ("интеграл", "NOUN", 6, "obl")]
    got = [(r.tok, r.tag) for r in dependency.detect(parse(spark, *rows), lex).orderBy("pos").collect()]
    assert got == [("Значит", O), ("икс", B), ("плюс", I), ("один", O), ("Поговорим", O), ("про", O), ("интеграл", O)]


def test_dependency_variable_filter(spark):
    lex = [(0, "a", "о", "VARIABLE", "phrase")]
    got = dependency.detect(parse(spark, ("о", "ADP", 1, "case"), ("нём", "PRON", None, "root")), lex)
    assert {r.tag for r in got.collect()} == {O}


def test_viterbi_forbids_orphans_and_matches_brute_force():
    from itertools import product

    rng = np.random.default_rng(1)
    moves = models.log_transitions([(O, O, 5), (O, B, 2), (B, I, 3), (I, O, 1), ("<s>", O, 2)])
    for _ in range(20):
        e = np.log(rng.dirichlet(np.ones(3), 6))
        score = lambda p: moves[3, p[0]] + e[0, p[0]] + sum(moves[a, b] + e[k + 1, b] for k, (a, b) in enumerate(zip(p, p[1:], strict=False)))  # noqa: E731, B023
        assert models.viterbi(e, moves) == list(max(product(range(3), repeat=6), key=score))


def test_early_stop(spark):
    log = spark.createDataFrame([("r", k, v) for k, v in enumerate([0.1, 0.3, 0.2, 0.25, 0.9])], "run string, epoch int, value double")
    assert tuple(models.early_stop(log, 2).first()) == ("r", 1, 3)


def test_tagger_plugin(spark):
    s = spark.createDataFrame([(0, ["a", "b"]), (1, ["c"])], "sid bigint, toks array<string>")
    got = models.tag_words(s, lambda t: ["X", "Y"]).orderBy("sid", "i").collect()
    assert [(r.tok, r.postag) for r in got] == [("a", "X"), ("b", "Y"), ("c", "UNK")]


def test_readers(spark, tmp_path):
    doc = tmp_path / "doc.txt"
    doc.mkdir()
    (doc / "admin.tsv").write_text("#FORMAT\n\n#Sentence.id=7\n#Text=old\n#Text=new\n1-1\t0-1\tx\tM\t_\t_\t_\t\n1-2\t2-3\tи\t_\t_\t_\ta.inception\t\nbad\trow\n\n#Sentence.id=8\n#Text=t\n2-1\t0-1\tz\t*\t_\t_\t_\t\n", encoding="utf-8")
    got = readers.webanno(spark, f"{tmp_path}/*/admin.tsv").orderBy("sent", "i").collect()
    assert [tuple(r) for r in got] == [("doc", "7", "new", 0, "x", True), ("doc", "7", "new", 1, "и", True), ("doc", "8", "t", 0, "z", False)]
    (tmp_path / "a.conllu").write_text("# c\n1\tОн\tон\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\tидёт\tидти\tVERB\t_\t_\t0\troot\t_\t_\n\n1\tДа\tда\tPART\t_\t_\t0\troot\t_\t_\n", encoding="utf-8")
    c = readers.conllu(spark, f"{tmp_path}/a.conllu").orderBy("sent", "idx").collect()
    assert [(r.idx, r.text, r.head, r.deprel) for r in c] == [(0, "Он", 1, "nsubj"), (1, "идёт", None, "root"), (0, "Да", None, "root")]
    (tmp_path / "b.conll").write_text("a O\nb O\n\nc B\n", encoding="utf-8")
    assert [(r.sent, r.i, r.tok, r.tag) for r in readers.conll2002(spark, f"{tmp_path}/b.conll").orderBy("sent", "i").collect()] == [(0, 0, "a", "O"), (0, 1, "b", "O"), (1, 0, "c", "B")]


def test_delimited_round_trip_keeps_nulls_quotes_and_blanks(spark, tmp_path):
    rows = [("a", ' "q" '), ("b", ""), ("c", None), ("d", "x\ty\nz"), ("NA", "NA")]
    sinks.tagged_table(spark.createDataFrame(rows, "k string, v string"), f"{tmp_path}/t")
    got = readers.delimited(spark, f"{tmp_path}/t", "k string, v string").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_lexicon_reader_without_yaml():
    text = '- id: m1\n  patterns:\n    - "больше"\n    - "больше или равно"\n  role: RELATION\n  match_type: phrase\n- id: m2\n  patterns:\n    - "x"\n  role: VARIABLE\n'
    assert [x[:4] for x in readers.lexicon_entries(text)] == [(0, "m1", "больше", "RELATION"), (1, "m1", "больше или равно", "RELATION"), (2, "m2", "x", "VARIABLE")]


def test_bio_violations_by_rule(spark):
    rows = spark.createDataFrame([("a", 0, "x", "O", "s", "test"), ("a", 1, "x", "O", "s", "val"), ("b", 0, "x", "Q", "s", "val"), ("c", 0, "x", "O", "s", "dev")], readers.BIO_SCHEMA)
    assert sorted(map(tuple, readers.bio_violations(rows).collect())) == [("several_splits", "a"), ("split", "c"), ("tag", "b")]


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="missing columns: tag"):
        readers.require(spark.createDataFrame([(1,)], "sid int"), ("sid", "tag"))


def test_empty_tables(spark):
    empty = tagged(spark, "B").where("false")
    assert bio.spans(empty).count() == 0
    assert evaluate.span_scores(empty, empty).first().f1 == 0.0
    assert bio.gap_spans(empty.withColumn("math", F.lit(True))).count() == 0


def test_greedy_choice_equals_a_loop(spark):
    rng = random.Random(11)
    vocab = ["a", "b", "c", "d"]
    roles = ["RELATION", "OBJECT", "BOUNDARY", "DISCOURSE_START", "VARIABLE"]
    entries = [(k, f"e{k}", " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 3))), rng.choice(roles), rng.choice(["phrase", "exact"])) for k in range(14)]
    sents = [[rng.choice([*vocab, "x"]) for _ in range(rng.randint(1, 14))] for _ in range(30)]
    expected = []
    for sid, toks in enumerate(sents):
        taken = {True: set(), False: set()}
        for _, ident, pattern, role, _ in sorted(entries, key=lambda x: (-len(x[2].split()), x[0])):
            parts, mine = pattern.split(), taken[role in lexicon.BOUNDARY_ROLES]
            for s in range(len(toks) - len(parts) + 1):
                if toks[s : s + len(parts)] == parts and not mine & set(range(s, s + len(parts))):
                    mine |= set(range(s, s + len(parts)))
                    expected.append((sid, s, s + len(parts), ident))
    words = spark.createDataFrame([(sid, i, t) for sid, s in enumerate(sents) for i, t in enumerate(s)], "sid bigint, i int, tok string")
    lex = spark.createDataFrame([(*e, "high") for e in entries], LEX)
    assert sorted((r.sid, r.s, r.e, r.id) for r in lexicon.resolve(lexicon.candidates(words, lex, 3)).collect()) == sorted(expected)


def test_mask_fit_is_the_best_of_all_gluings():
    from itertools import combinations

    rng = random.Random(12)
    words, zero = frozenset({"икс", "плюс"}), frozenset({"и"})
    for _ in range(200):
        toks = [rng.choice(["икс", ",", "плюс", "2", "y", "да", ".", "и"]) for _ in range(rng.randint(2, 7))]
        mask = "".join(rng.choice("01") for _ in range(rng.randint(1, len(toks) - 1)))
        free = [k for k in range(1, len(toks)) if align.gluable(toks[k - 1], toks[k])]

        def score(glued, toks=toks, mask=mask):
            total, j = 0, 0
            for k, t in enumerate(toks):
                if k in glued:
                    if align.PUNCT.match(t) and j:
                        total += -8 if mask[j - 1] == "1" else 1
                else:
                    s = align.likeness(t, words, zero)
                    total += s if mask[j] == "1" else -s if s > 2 else 0
                    j += 1
            return total

        best = max((score(set(g)) for g in combinations(free, len(toks) - len(mask))), default=None)
        got = align.fit_mask(toks, mask, words, zero)
        assert (got is None) == (best is None)
        if got:
            assert len(got) == len(mask) and "".join(got) == "".join(toks)
            ends, at = set(), 0
            for g in got:
                ends.add(at)
                while g:
                    g = g[len(toks[at]) :]
                    at += 1
            assert score({k for k in range(len(toks)) if k not in ends}) == best


def test_ordinals_run_on_over_partitions(spark):
    from spanspark.storage import with_ordinals

    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(9)
    assert [r.ordinal for r in with_ordinals(df, "k").orderBy("k").collect()] == list(range(1000))
    assert sorted(r.ordinal for r in with_ordinals(df).collect()) == list(range(1000))


def test_subtree_sizes_close_trees_of_any_depth(spark):
    """Against a walk from each node: a chain of 50, the stand-in's tree, a random tree, a cycle."""
    rng = random.Random(3)
    heads = [[None, *range(49)], [None if i % 5 == 0 or i == 1 else i - 1 - i % 2 for i in range(60)], [None, *(rng.randrange(i) for i in range(1, 60))], [1, 2, 0, 2, None]]
    expected = set()
    for sid, own in enumerate(heads):
        for top in range(len(own)):
            found, queue = set(), [top]
            while queue:
                if (k := queue.pop()) not in found:
                    found.add(k)
                    queue += [c for c, h in enumerate(own) if h == k]
            expected.add((sid, top, len(found)))
    nodes = spark.createDataFrame([(sid, i, h) for sid, own in enumerate(heads) for i, h in enumerate(own)], "sid bigint, i int, head int")
    assert {(r.sid, r.top, r["size"]) for r in dependency.subtree_sizes(nodes).collect()} == expected


def test_whole_token_pairs_pass_token_30_and_end_with_the_shorter_side(spark):
    from conftest import DATA

    from spanspark.plans.catalog import QUERIES
    from spanspark.plans.registry import pred

    whole = QUERIES["j4_token_pairs"](spark, DATA)
    assert whole.count() == pred(spark, DATA).count()
    assert whole.where("i >= 30").count() == pred(spark, DATA).where("i >= 30").count()
    gold, short = tagged(spark, "BIO" * 15, "OOB"), tagged(spark, "BIO" * 14, "OOBII")
    assert sorted((r.sid, r.i) for r in evaluate.token_pairs(gold, short).collect()) == [(0, i) for i in range(42)] + [(1, i) for i in range(3)]


def test_whole_metadata_filter_judges_whole_texts_and_nulls(spark, tmp_path):
    from spanspark.plans.catalog import QUERIES

    long = "line of text\n" * 500
    texts = [long, long, long + "Title: x", long, '"' * 50 + "Title: x\n" + long, None, None, None, None, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.is_metadata for r in QUERIES["p1_metadata_filter"](spark, str(tmp_path)).collect()}
    assert got == {k: k != 2 for k in range(10)}


def test_regex_entries_match_whole_words_from_left_to_right(spark):
    lex = spark.createDataFrame([
        (0, "a", "больше или равно", "RELATION", "phrase", "high"), (1, "r", "больше( или равно)?|мен.ше", "RELATION", "regex", "high"), (2, "n", "равно ноль", "NEGATIVE_CONTEXT", "regex", None), (3, "m", "но", "OPERATOR", "regex", None),
    ], LEX)
    words = spark.createDataFrame([(0, i, t) for i, t in enumerate("икс больше или равно ноль".split())] + [(1, i, t) for i, t in enumerate("Больше, меньше но больше или равно".split())] + [(2, 0, "большене")], "sid bigint, i int, tok string")
    got = sorted((r.sid, r.s, r.e, r.id) for r in lexicon.matches(words, lex, 3).collect())
    assert got == [(0, 1, 4, "a"), (0, 3, 5, "n"), (1, 0, 1, "r"), (1, 1, 2, "r"), (1, 2, 3, "m"), (1, 3, 6, "a")]
    assert sorted((r.sid, r.s, r.e, r.id) for r in lexicon.regex_spans(words, lex).where("id = 'r'").collect()) == [(0, 1, 4, "r"), (1, 0, 1, "r"), (1, 1, 2, "r"), (1, 3, 6, "r")]


def test_regex_matches_equal_a_plain_scan(spark):
    """Brute force over all word ranges, leftmost first."""
    rng = random.Random(3)
    for _ in range(200):
        forms = [rng.choice(["a", "b", "ab", "", "ba"]) for _ in range(rng.randint(0, 8))]
        pattern = re.compile(rng.choice(["a b", "a|b", "ab?( a)?", "b+"]))
        line, place = " ".join(forms), [(sum(len(x) + 1 for x in forms[:k]), sum(len(x) + 1 for x in forms[:k]) + len(f)) for k, f in enumerate(forms)]
        expected = []
        for m in pattern.finditer(line):
            hit = [(s, e + 1) for s in range(len(forms)) for e in range(s, len(forms)) if place[s][0] == m.start() and place[e][1] == m.end() and m.end() > m.start()]
            expected += hit[:1]
        assert [x[:2] for x in lexicon.regex_matches(forms, [(0, "r", pattern, "OBJECT")])] == expected


def test_lemma_entries_match_lemmas(spark):
    lex = spark.createDataFrame([(0, "l", "равный", "RELATION", "lemma", None), (1, "p", "равна", "OBJECT", "phrase", None), (2, "q", "сумма равный", "OBJECT", "lemma", None)], LEX)
    words = spark.createDataFrame([(0, 0, "Сумма", "сумма"), (0, 1, "равна", "равный"), (0, 2, "равный", None), (1, 0, "равный", "другой")], "sid bigint, i int, tok string, lemma string")
    assert sorted((r.sid, r.s, r.e, r.id) for r in lexicon.candidates(words, lex, 2).collect()) == [(0, 0, 2, "q"), (0, 1, 2, "l"), (0, 1, 2, "p"), (0, 2, 3, "l")]
    assert sorted((r.s, r.id) for r in lexicon.candidates(words.drop("lemma"), lex, 2).where("sid = 0").collect()) == [(1, "p"), (2, "l")]


def test_dependency_detector_uses_regexes_and_lemmas(spark):
    rows = [("икс", "NOUN", None, "root"), ("равна", "ADJ", 0, "acl"), ("пяти", "NUM", 1, "obl")]
    tokens = parse(spark, *rows).withColumn("lemma", F.when(F.col("text") == "равна", "равный").otherwise(F.col("text")))
    for entry in ((0, "r", "ра.на", "RELATION", "regex"), (0, "l", "равный", "RELATION", "lemma")):
        assert [r.tag for r in dependency.detect(tokens, [entry]).orderBy("pos").collect()][1] == B
    assert {r.tag for r in dependency.detect(tokens, [(0, "p", "равный", "RELATION", "phrase")]).collect()} == {O}


def test_confidence_of_lexicon_words(spark):
    """A missing or unknown confidence is the lowest; words of one letter, regex patterns and negative contexts stay out."""
    lex = spark.createDataFrame([(0, "a", "икс плюс", "OPERATOR", "phrase", None), (1, "b", "плюс", "OPERATOR", "phrase", "odd"), (2, "c", "и больше", "RELATION", "phrase", "medium"), (3, "d", "больше", "RELATION", "phrase", "low"), (4, "e", "не", "NEGATIVE_CONTEXT", "phrase", "high"), (5, "f", "a|b", "OBJECT", "regex", "high"), (6, "g", "ноль", None, "phrase", "high")], LEX)
    assert sorted(map(tuple, features.role_confidence(lex).collect())) == [("больше", "RELATION", 2), ("икс", "OPERATOR", 1), ("ноль", "NONE", 3), ("плюс", "OPERATOR", 1)]


def test_broken_lexicon_file_falls_back_to_lines():
    body = '- id: m1\n  patterns:\n    - "больше"\n  role: RELATION\n  match_type: exact\n  confidence: high\n'
    assert readers.lexicon_entries(body) == [(0, "m1", "больше", "RELATION", "exact", "high")]
    for broken in ("x: [1\n" + body, "\t" + body, "entries: 3\n---\n" + body):
        assert readers.lexicon_entries(broken) == [(0, "m1", "больше", "RELATION", "exact", "medium")]


def test_gazetteer_phrases():
    assert readers.gazetteer_phrases('entries:\n  - phrase: "сумма ряда"\n  - phrase: "—"\n  - other: 1\n  - phrase: предел\n') == [("gazetteer_0", "сумма ряда"), ("gazetteer_3", "предел")]
    assert readers.gazetteer_phrases("") == []


def test_lines_of_a_split_file_keep_their_order(spark, tmp_path):
    (tmp_path / "x.conll").write_text("".join(f"w{k} O\n" + "\n" * (k % 7 == 6) for k in range(3000)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.text(f"{tmp_path}/x.conll").rdd.getNumPartitions() > 3
        got = readers.conll2002(spark, f"{tmp_path}/x.conll").orderBy("sent", "i").collect()
        assert [(r.sent, r.i, r.tok) for r in got] == [(k // 7, k % 7, f"w{k}") for k in range(3000)]
        numbered = readers.interactive(spark, path=f"{tmp_path}/x.conll").orderBy("sid").collect()
        assert [r.text for r in numbered] == [f"w{k} O" for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_report_equals_its_parts(spark):
    rng = random.Random(5)

    def tags(skip):
        return [(s, i, rng.choice([O, O, B, I])) for s in range(30) if s % 7 != skip for i in range(rng.randint(1, 9))]

    for _ in range(3):
        gold, pred = (spark.createDataFrame(tags(k), "sid bigint, i int, tag string") for k in (2, 3))
        r = evaluate.report(gold, pred).first()
        assert r.span_f1 == evaluate.span_scores(gold, pred).first().f1
        assert r.token_f1 == evaluate.token_scores(gold, pred).first().f1
        assert (r.n_sentences, r.exact_match) == (evaluate.exact_match(gold, pred).first().n, evaluate.exact_match(gold, pred).first().exact_match)
        assert r.n_tokens == evaluate.token_pairs(gold, pred).count()


def test_reject_reasons(spark):
    lines = [(0, "[MATH]a b[/MATH] c"), (1, "no tags"), (2, "[/MATH]a[MATH]"), (3, "[MATH]a[/MATH] спан"), (4, "[MATH]a , b[/MATH]")]
    got = {r.sid: r.reason for r in bio.reject_reasons(spark.createDataFrame(lines, "sid bigint, text string")).collect()}
    assert got == {0: None, 1: "counts", 2: "nesting", 3: "leak", 4: None}


def test_sequence_model_on_held_out_sentences(spark):
    """Span and token F1 of the fitted model on sentences it hasn't seen, where context decides the tags."""
    rng = random.Random(1)
    rows = []
    for s in range(160):
        toks = [rng.choice(["let", "so", "then", "and"]) for _ in range(3)] + rng.choice([["x", "plus", "y"], ["x", "minus", "z"], ["alpha"]]) + [rng.choice(["holds", "and", "so"]) for _ in range(2)]
        math = [t in ("x", "plus", "y", "minus", "z", "alpha") for t in toks]
        rows += [(s, i, t, (I if i and math[i - 1] else B) if m else O) for i, (t, m) in enumerate(zip(toks, math, strict=True))]
    x = features.surface(spark.createDataFrame(rows, "sid bigint, i int, tok string, tag string")).withColumn("label", bio.encode(F.col("tag")).cast("double"))
    x = bio.context(x.select("sid", "i", "tag", "label", "lower", "suffix3", "shape"), ("lower",), (-1, 1))
    train, test = x.where("sid % 4 <> 0"), x.where("sid % 4 = 0")
    model = models.fit_emissions(train, ("lower", "suffix3", "shape", "lower_m1", "lower_p1"), steps=20)
    moves = models.log_transitions([(r.before, r.tag, r.n) for r in models.transitions(train).collect()])
    found = models.decode(models.emission_scores(model, test), moves)
    assert evaluate.span_scores(test, found).first().f1 > 0.95 and evaluate.token_scores(test, found).first().f1 > 0.95
    assert found.join(bio.violations(found), ["sid", "i"], "left_semi").isEmpty()


def test_checkpoint_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from spanspark import storage

    made = []
    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: made[-1] if made else None, setCheckpointDir=made.append)
    session = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda name, default: default))
    with pytest.raises(ValueError):
        storage.shared_folder(session)
    session.conf.get = lambda name, default: "/shared"
    assert storage.shared_folder(session) == "/shared"
