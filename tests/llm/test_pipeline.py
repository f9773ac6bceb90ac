"""The pipeline against brute force on a small table."""

import random

import pytest
from pyspark.sql import functions as F
from test_llm import brute_components, brute_lines, frame

import corpus_pipeline
from spanspark.llm import decontam, neardup, rules


def test_pipeline_equals_plain_steps(spark, tmp_path):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(k, say(30)) for k in range(3)]
    common = say(14)
    texts = []
    for k in range(40):
        text = "\n".join(say(30) for _ in range(3))
        if k % 4 == 1:
            text += "\n" + common
        if k % 9 == 2:
            text = text + " " + items[k % 3][1]
        if k % 7 == 3:
            text = texts[-1] + " more words here"
        if k % 10 == 9:
            text = " ".join("#" * 3 + w for w in say(80).split())
        texts.append(text)
    texts += [None, "", "too short", texts[0], texts[5]]
    ids = [*range(len(texts) - 1), 5]
    docs = frame(spark, texts, ids)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    judged = rules.measure(docs.select("doc_id", "text")).collect()
    good = {r.doc_id for r in judged if r.kept}
    now = [(i, t) for i, t in zip(ids, texts, strict=True) if i in good]
    now = [(i, t) for i, _, _, t in brute_lines([i for i, _ in now], [t for _, t in now])]
    parts = brute_components([i for i, _ in now], [t for _, t in now])
    seen, left = set(), []
    for (i, t), (_, _, _, kept) in zip(now, parts, strict=True):
        if kept and (i, t) not in seen:
            seen.add((i, t))
            left.append((i, t))
    held = {r.doc_id for r in decontam.find(frame(spark, [t for _, t in left], [i for i, _ in left]), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    expected = sorted(i for i, _ in left if i not in held)

    stage, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), docs.columns
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == columns
    assert sorted(r.doc_id for r in stage.collect()) == expected
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(set(expected))
    assert 0 < len(expected) < len(texts)


@pytest.mark.parametrize("named_rows", [0, 1_000_000])
def test_rows_without_words_stay_and_copies_go(spark, monkeypatch, named_rows):
    monkeypatch.setattr(corpus_pipeline, "NAMED_ROWS", named_rows)
    docs = frame(spark, ["", "", None, "a b c d e f", "a b c d e f", "a b c d e f"], [1, 1, None, 4, 4, 5])
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (1, ""), (1, ""), (4, "a b c d e f")]
    assert kept[0].asDict().keys() == set(docs.columns)


def test_empty_documents(spark, tmp_path):
    none = frame(spark, ["x"]).where("false")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_any_column_names(spark, tmp_path):
    """Columns called like the stages' own, with dots, backticks and blanks, come through every stage as they were."""
    names = ["stays", "named_doc", "key_doc", "KEY_ROW", "named_row", "kept_row", "a.b", "we`ird", "two words", "row", "doc", "whole", "keep", "n", "first", "pipeline_doc", "m", "w", "ws"]
    rng = random.Random(2)
    say = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    texts = [say(80) for _ in range(6)]
    texts += [texts[0], texts[1] + " more", None, ""]
    rows = [(k, t, *(f"{c}{k}" for c in names)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in names))
    spark.createDataFrame([(1, say(12))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        left = {tuple(r) for r in out.collect()}
        assert left and {(r[0], *r[2:]) for r in left} <= {(r[0], *r[2:]) for r in rows}, name
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 1, 2, 3, 4, 5, 8, 9}


def test_near_dedup_does_not_send_far_texts_to_all_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    sent = []
    meet = neardup.meet
    monkeypatch.setattr(neardup, "meet", lambda docs, spots, n: (sent.append(spots.select(F.sum(F.col("place.times_i") * F.col("place.times_j"))).first()[0] or 0), meet(docs, spots, n))[1])
    rng = random.Random(12)
    texts = []
    for k in range(240):
        w = [f"w{j}" for j in range(150)]
        for at in rng.sample(range(150), 1 if k % 3 else 10):
            w[at] = f"x{k}_{at}"
        texts.append(" ".join(w))
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), "").select("doc_id").collect()}
    assert kept == {i for i, _, _, stays in brute_components(list(range(len(texts))), texts) if stays}
    assert sum(sent[2:]) < sent[0], sent
