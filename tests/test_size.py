"""What keeps operators bounded at size: plans without broadcasts of tokens, short batches, work in proportion to the input."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from spanspark import storage
from spanspark.operators import align, bio, crf, dependency, lexicon, models
from spanspark.plans.catalog import QUERIES
from spanspark.plans.registry import flagged
from spanspark.sources import readers


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def voted(ours, other):
    """i to j by the definition: running numbers of all letters and digits, most votes, then the first voted."""
    chars = lambda toks: [(k, c) for k, t in enumerate(toks) for c in re.findall(r"[^\W_]", t.lower())]
    votes = {}
    for at, ((i, a), (j, b)) in enumerate(zip(chars(ours), chars(other), strict=False)):
        if a == b:
            n, first = votes.get((i, j), (0, at))
            votes[i, j] = n + 1, first
    best = {i: min((-n, first, j) for (k, j), (n, first) in votes.items() if k == i)[2] for i, _ in votes}
    return [best.get(i) for i in range(len(ours))]


def test_char_votes_by_brute_force(spark):
    rng = random.Random(5)
    pick = lambda: ["".join(rng.choice("abAB1-,") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 9))]
    pairs = {sid: (pick(), pick()) for sid in range(60)}
    ours, other = (spark.createDataFrame([(sid, i, t) for sid, p in pairs.items() for i, t in enumerate(p[k])], "sid bigint, i int, tok string") for k in (0, 1))
    found = {(r.sid, r.i): r.j for r in align.char_votes(ours, other).collect()}
    assert found == {(sid, i): j for sid, (a, b) in pairs.items() for i, j in enumerate(voted(a, b))}


def test_majority_vote_broadcasts_no_characters(spark):
    assert "Broadcast" not in plan(QUERIES["a9_majority_vote"](spark, DATA))


def test_char_alignment_broadcasts_no_tokens(spark):
    for name in ("j12_char_alignment", "j13_fast_path_or_alignment"):
        assert "Broadcast" not in plan(QUERIES[name](spark, DATA))


def test_spoken_variable_filter_broadcasts_the_lexicon_only(spark):
    p = plan(QUERIES["p14_spoken_variable_filter"](spark, DATA))
    assert "BuildLeft" not in p and "LeftSemi, BuildRight" not in p and "LeftAnti, BuildRight" not in p


def test_large_lexicons_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_BROADCAST", 3)
    assert "Broadcast" not in plan(QUERIES["j10_ngram_join"](spark, DATA))


def test_annotation_folders_are_read_from_one_root(spark, tmp_path):
    for k in range(40):  # more than the folders that Spark lists without a job
        (tmp_path / f"a{k}.txt").mkdir()
        (tmp_path / f"a{k}.txt" / "admin.tsv").write_text(f"#Sentence.id=s{k}\n#Text=x y\n1-1\t0-1\tx\tMathFormula\t_\n1-2\t2-3\ty\t_\t_\n")
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    x = readers.webanno(spark, str(tmp_path))
    assert spark.conf.get(name) == before
    assert "InMemoryFileIndex(1 paths)" in plan(x)
    assert {(r.doc, r.sent, r.i, r.tok, r.math) for r in x.collect()} == {(f"a{k}", f"s{k}", i, t, i == 0) for k in range(40) for i, t in enumerate("xy")}


def test_annotation_scan_gives_the_planner_one_path(spark):
    for name in ("s1_webanno_scan", "s1_webanno_scan_by_prefix", "s2_directory_enumeration"):
        assert "InMemoryFileIndex(1 paths)" in plan(QUERIES[name](spark, DATA))


def test_workers_hold_one_sentence_as_objects_and_send_short_batches(spark, monkeypatch):
    monkeypatch.setattr(storage, "ROWS_OUT", 10)
    made = []
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([["x"] * 5] * 7)], ["sid", "rows"])

    def rows():
        for sid, found in storage.one_by_one([batch], "sid", "rows"):
            made.append(sid)
            yield from ((sid, x) for x in found)

    out = storage.sent(rows(), ("sid", "x"), (pa.int64(), pa.string()))
    assert next(out).num_rows == 10 and len(made) == 2
    assert [b.num_rows for b in out] == [10, 10, 5] and made == list(range(7))


@pytest.mark.parametrize("name", ["h4_math_head_climb", "h6_anchored_expansion", "h5_relation_expansion", "h12_detect_dependency", "h12_detect_lexical", "m4_parser_plug_in", "h2_greedy_matching_words", "h1_mask_alignment"])
def test_batches_of_sentences_are_bounded(spark, name):
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, str(1 << 30))
    try:
        QUERIES[name](spark, DATA)
        assert int(spark.conf.get(conf)) <= 4 << 20
    finally:
        spark.conf.set(conf, before)


def test_gap_merge_has_no_frame_up_to_the_end(spark):
    assert "unboundedfollowing" not in plan(bio.gap_merge(flagged(spark, DATA))).lower()


def test_gap_merge_equals_gap_spans(spark):
    rng = random.Random(2)
    rows = [(sid, i, rng.choice(["a", "b", "c."]), rng.random() < 0.3) for sid in range(80) for i in range(rng.randint(1, 25))]
    tokens = spark.createDataFrame(rows, "sid bigint, i int, tok string, math boolean")
    for gap in (0, 2):
        expected = {(r.sid, r.i): r.tag for r in bio.paint(bio.gap_spans(tokens, gap), tokens).collect()}
        assert {(r.sid, r.i): r.tag for r in bio.gap_merge(tokens, gap).collect()} == expected


def test_reject_reasons_shuffle_nothing(spark):
    assert "Exchange" not in plan(QUERIES["p6_reject_reasons"](spark, DATA))


def test_broken_tags_inside_a_line_as_by_windows(spark):
    rng = random.Random(4)
    lines = [(k, "".join(rng.choice(["[MATH]", "[/MATH]", " a", " ,", " b.", " !", " "]) for _ in range(rng.randint(0, 14)))) for k in range(300)]
    df = spark.createDataFrame(lines, "sid bigint, text string")
    slow = {r.sid for r in bio.violations(bio.punct_outside(bio.parse_tagged(df))).collect()}
    assert {r.sid for r in df.where(bio.breaks(F.col("text"))).collect()} == slow


def test_subword_labels_sort_no_subwords(spark):
    p = plan(QUERIES["p16_ignore_index"](spark, DATA))
    assert "part" not in "".join(x for x in p.splitlines() if "Sort [" in x) and p.count("Sort [") == 1


def test_subword_labels_in_the_order_of_place_and_part(spark):
    rng = random.Random(6)
    rows = [(sid, rng.randint(0, 5), 1, rng.randint(1, 4)) for sid in range(30) for _ in range(rng.randint(1, 9))]  # with several words at a place
    x = models.subword_labels(spark.createDataFrame(rows, "sid bigint, i int, label int, n int"), F.col("n")).collect()
    for sid in range(30):
        expected = sorted((i, part) for s, i, _, n in rows if s == sid for part in range(n))
        assert sorted((r.j, r.i, r.label) for r in x if r.sid == sid) == [(j, i, None if part else 1) for j, (i, part) in enumerate(expected)]


def test_subtree_sizes_by_brute_force():
    """Trees, cycles, heads that are no nodes, and nodes with two heads."""
    rng = random.Random(8)
    for k in range(400):
        n = rng.randint(1, 9)
        links = [(i, rng.choice([None, rng.randint(0, n)])) for i in range(n)] + ([(0, rng.randint(0, n))] if k % 4 == 0 else [])
        pairs = {(i, i) for i, _ in links}
        while more := {(a, h) for a, b in pairs for i, h in links if i == b and h is not None} - pairs:
            pairs |= more
        assert dependency.sizes(*zip(*links, strict=True)) == {top: sum(b == top for _, b in pairs) for _, top in pairs}


def test_subtree_sizes_shuffle_tokens_once(spark):
    p = plan(QUERIES["h3_subtree_sizes"](spark, DATA))
    assert "Join" not in p and "ExistingRDD" not in p and p.count("Exchange") == 1  # no checkpoint of pairs either


def test_best_paths_of_many_sentences_at_once():
    draw = np.random.default_rng(3)
    for _ in range(30):
        lengths = draw.integers(1, 12, draw.integers(1, 20))
        own, moves = draw.integers(-2, 3, (lengths.sum(), 3)).astype(float), draw.integers(-2, 3, (4, 3)).astype(float)  # with ties
        moves[[0, 3], 2] = -np.inf
        expected = [k for part in np.split(own, np.cumsum(lengths)[:-1]) for k in models.viterbi(part, moves)]
        assert crf.best_paths(own, lengths, moves).tolist() == expected
