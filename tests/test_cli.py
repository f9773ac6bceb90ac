"""The command line over small files."""

import io
import json

from spanspark import cli
from spanspark.operators import corpus, dependency
from spanspark.sources import sinks

MARKERS = '- id: m1\n  patterns:\n    - "икс"\n    - "икс плюс"\n  role: RELATION\n  match_type: phrase\n- id: m2\n  patterns:\n    - "зет"\n  role: OBJECT\n  match_type: phrase\n'


def bio_file(spark, path, tags):
    rows = [(f"s{k}", i, f"w{i}", {"B": "B-MATH", "I": "I-MATH", "O": "O"}[t], "x", "test") for k, s in enumerate(tags) for i, t in enumerate(s)]
    sinks.tagged_table(spark.createDataFrame(rows, "sid string, i int, tok string, tag string, source string, split string"), path)


def test_evaluate(spark, tmp_path, capsys):
    bio_file(spark, f"{tmp_path}/g.tsv", ["BIO", "OBO"])
    bio_file(spark, f"{tmp_path}/p.tsv", ["BIO", "BIO"])
    assert cli.main(["evaluate", "--gold", f"{tmp_path}/g.tsv", "--pred", f"{tmp_path}/p.tsv", "--split", "test", "--json", f"{tmp_path}/m"]) == 0
    got = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert got["span_f1"]["f1"] == 0.5 and got["n_sentences"] == 2 and got["exact_match"] == 0.5
    assert cli.main(["evaluate", "--gold", f"{tmp_path}/g.tsv", "--self-test"]) == 0


def test_detect(spark, tmp_path, capsys):
    (tmp_path / "m.yaml").write_text(MARKERS, encoding="utf-8")
    assert cli.main(["detect", "--text", "Пусть икс плюс, да\nпро зет", "--markers", f"{tmp_path}/m.yaml", "--include-punct"]) == 0
    out = [x.split() for x in capsys.readouterr().out.strip().splitlines()]
    assert [(x[0], x[2], x[4]) for x in out] == [("input_0000", "Пусть", "O"), ("input_0000", "икс", "B-MATH"), ("input_0000", "плюс", "I-MATH"), ("input_0000", ",", "O"), ("input_0000", "да", "O"), ("input_0001", "про", "O"), ("input_0001", "зет", "O")]
    (tmp_path / "p.conllu").write_text("1\tикс\tикс\tNOUN\t_\t_\t0\troot\t_\t_\n2\tплюс\tплюс\tNOUN\t_\t_\t1\tnmod\t_\t_\n", encoding="utf-8")
    assert cli.main(["detect", "--parses", f"{tmp_path}/p.conllu", "--markers", f"{tmp_path}/m.yaml", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["bio"] == ["B-MATH", "I-MATH"]


def test_detect_with_gazetteer_and_standard_input(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "m.yaml").write_text(MARKERS, encoding="utf-8")
    (tmp_path / "g.yaml").write_text('entries:\n  - phrase: "сумма ряда"\n', encoding="utf-8")
    monkeypatch.setattr("sys.stdin", io.StringIO("вот сумма ряда\nпросто зет\n"))
    assert cli.main(["detect", "--input", "-", "--markers", f"{tmp_path}/m.yaml", "--gazetteer", f"{tmp_path}/g.yaml"]) == 0
    out = [x.split() for x in capsys.readouterr().out.strip().splitlines()]
    assert [(x[2], x[4]) for x in out] == [("вот", "O"), ("сумма", "B-MATH"), ("ряда", "I-MATH"), ("просто", "O"), ("зет", "B-MATH")]


def test_parses_of_several_sentences_are_numbered(spark, tmp_path, capsys):
    (tmp_path / "m.yaml").write_text(MARKERS, encoding="utf-8")
    line = lambda w: f"1\t{w}\t{w}\tNOUN\t_\t_\t0\troot\t_\t_\n"
    (tmp_path / "p.conllu").write_text("\n".join(map(line, ["икс", "да", "зет"])), encoding="utf-8")
    assert cli.main(["detect", "--parses", f"{tmp_path}/p.conllu", "--markers", f"{tmp_path}/m.yaml"]) == 0
    assert [x.split()[::2] for x in capsys.readouterr().out.strip().splitlines()] == [["input_0001", "икс", "B-MATH"], ["input_0002", "да", "O"], ["input_0003", "зет", "B-MATH"]]


def test_export_features(spark, tmp_path):
    (tmp_path / "m.yaml").write_text(MARKERS, encoding="utf-8")
    rows = [("s", k, t, "O", "x", "test") for k, t in enumerate(["Пусть", "икс", "зет"])]
    sinks.tagged_table(spark.createDataFrame(rows, "sid string, i int, tok string, tag string, source string, split string"), f"{tmp_path}/t.tsv")
    assert cli.main(["export-features", "--input", f"{tmp_path}/t.tsv", "--markers", f"{tmp_path}/m.yaml", "--output", f"{tmp_path}/f"]) == 0
    got = spark.read.parquet(f"{tmp_path}/f").orderBy("i").collect()
    assert [(r.lower, r.role, r.is_math, r.role_p1) for r in got] == [("пусть", "NONE", False, "RELATION"), ("икс", "RELATION", True, "OBJECT"), ("зет", "OBJECT", True, "EOS")]


def test_convert_and_export(spark, tmp_path, capsys):
    (tmp_path / "in.txt").write_text("Пусть [MATH]икс[/MATH] .\n\nбез тегов\n[MATH]a , b[/MATH]\n", encoding="utf-8")
    merged = f"{tmp_path}/merged"
    for _ in range(2):
        assert cli.main(["convert-generated", "--input", f"{tmp_path}/in.txt", "--output", f"{tmp_path}/out", "--append-to-merged", "--merged-path", merged]) == 0
    rows = spark.read.parquet(merged).orderBy("sid", "i").collect()
    assert [(r.sid, r.tok, r.tag) for r in rows] == [("llm_0000", "Пусть", "O"), ("llm_0000", "икс", "B-MATH"), ("llm_0000", ".", "O"), ("llm_0001", "a", "B-MATH"), ("llm_0001", ",", "O"), ("llm_0001", "b", "B-MATH")]
    assert cli.main(["export", "--input", merged, "--output", f"{tmp_path}/ds"]) == 0
    assert spark.read.parquet(f"{tmp_path}/ds").count() == 2


def test_prompts(spark, tmp_path, capsys):
    sinks.samples_csv(spark.createDataFrame([(f"formula {k}", "") for k in range(9)], "pronunciation string, sentence_normalized string"), f"{tmp_path}/s2l")
    assert cli.main(["prompts", "--s2l-path", f"{tmp_path}/s2l", "--num-batches", "2", "--batch-size", "4"]) == 0
    out = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert [len(set(x["prompt"].splitlines()[1:])) for x in out] == [4, 4]


def test_backoff_doubles_its_waits():
    waits, answers = [], iter([RuntimeError(), RuntimeError(), "ok"])

    def call(prompt):
        x = next(answers)
        if isinstance(x, Exception):
            raise x
        return x

    assert corpus.backoff(call, "p", wait=waits.append) == "ok" and waits == [5.0, 10.0]


def test_parser_plug_in_feeds_the_detector(spark):
    df = spark.createDataFrame([(1, "икс плюс"), (2, None)], "sid bigint, text string")
    parsed = dependency.parse_texts(df, lambda: lambda text: [(t, t, "NOUN", None if k == 0 else 0, "nmod", 0) for k, t in enumerate(text.split())])
    got = dependency.detect(parsed, [(0, "a", "икс", "RELATION", "phrase"), (1, "b", "плюс", "OPERATOR", "phrase")]).orderBy("pos").collect()
    assert [r.tag for r in got] == ["B-MATH", "I-MATH"]
    assert dependency.expansions(parsed, [(0, "a", "икс", "RELATION", "phrase")]).first().expanded == 2
