"""Exact rules of tokens, predicates, readers and labels on hand-written rows."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import predicates as p
from weftline.functions import text as tx
from weftline.operators import tokenize as t
from weftline.operators.labels import full_labels
from weftline.sources import text as src


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()["y"]


CASES = {
    "cinema...": ["cinema", "..."], "3.14!": ["3", ".14!"], "a,b c": ["a", ",", "b", "c"], "a-b-c d": ["a", "-b", "-c", "d"], "a-b,c d": ["a", "-b,c", "d"], "foo, bar.": ["foo", ",", "bar", "."],
    ",x y": [",", "x", "y"], "etc. stop": ["etc.", "stop"], "foo. ": ["foo", "."], "": [], " \t ": [], "!": ["!"], "--a b": ["-", "-a", "b"], "a;b x": ["a;b", "x"], "a:,b x": ["a", ":", ",", "b", "x"], "-a-b x": ["-a", "-b", "x"],
}


def slow_tokens(line):
    """The rules as they are stated: peel, split, start again."""
    work = [x for x in line.replace("\t", " ").split(" ") if x]
    out = []
    while work:
        item, last = work[0], len(work) == 1
        rest = work[1:]
        marks = [i for i, c in enumerate(item) if c in ".!?"]
        if last and item[-1] in ".!?":
            cut = [item] if marks[0] == 0 else [item[: marks[0]], item[marks[0] :]]
        elif item in ("etc", "etc.") or item.isalpha():
            cut = [item]
        elif item[-1] in ",:-–;":
            cut = [item] if len(item) == 1 else [item[:-1], item[-1]]
        elif "-" in item:
            at = item.rindex("-")
            cut = [item] if at == 0 else [item[:at], item[at:]]
        elif "," in item:
            at = item.index(",")
            cut = [",", item[1:]] if at == 0 else [item[: at + 1], item[at + 1 :]]
        else:
            cut = [item]
        if len(cut) == 1:
            out.append(item)
            work = rest
        else:
            work = cut + rest
    return out


def test_tokens(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "i int, line string")
    got = {r["line"]: r["w"] for r in df.select("line", t.tokens_of(F.col("line")).alias("w")).collect()}
    assert got == CASES == {k: slow_tokens(k) for k in CASES}
    assert {r["line"]: r["w"] for r in t.tokenized(df, "line", "w").collect()} == CASES


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab1.,-:;–!? \t", max_size=14), min_size=30, max_size=60))
def test_tokens_follow_the_rules_and_lose_nothing(spark, found):
    df = spark.createDataFrame([(x,) for x in found], "line string").select("line", t.tokens_of(F.col("line")).alias("w"))
    for r in df.collect():
        assert r["w"] == slow_tokens(r["line"])
        assert "".join(r["w"]) == r["line"].replace(" ", "").replace("\t", "")


@pytest.mark.parametrize(
    "fn, yes, no",
    [
        (p.is_punct, [".", "%"], ["...", "–", "a", ""]),
        (p.is_mark, [".", "–"], ["a", "1", "..", ""]),
        (p.has_mark, ["a.b"], ["ab", ""]),
        (p.only_marks, ["...", ""], ["a."]),
        (p.ends_with_mark, ["a."], ["a", ""]),
        (p.first_is_capital, ["Ab", "Éa"], ["ab", "1b", ""]),
        (p.all_capitals, ["AB1"], ["Ab", "12", ""]),
        (p.many_capitals, ["AB", "A1", "11"], ["Ab", "a"]),
        (p.is_numeric, ["1.234,5", "12-3"], ["a1", "", "."]),
        (p.is_label_token, [".", "!", "word"], ['"', "%"]),
        (p.is_comment, ["# x", "  #"], ["x #"]),
        (p.is_real_phone, ["a"], ["#a"]),
    ],
)
def test_predicates(spark, fn, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    got = {r["x"]: r["y"] for r in df.select("x", fn(F.col("x")).alias("y")).collect()}
    assert got == {x: True for x in yes} | {x: False for x in no}


def test_small_strings(spark):
    assert one(spark, "", p.first_char(F.col("x"))) == "_" and one(spark, "ab", p.last_char(F.col("x"))) == "b"
    assert one(spark, "a\\x12b é", tx.ascii_only(F.col("x"))) == "ab"
    assert one(spark, "pp^p-c+n=nn/A:1/B:2", tx.label_phone(F.col("x"))) == "c"
    assert one(spark, ["ab", "-", "c.d"], t.phones_of(F.col("x")), "array<string>") == ["ab", "c", "d"]
    assert one(spark, ["cl:a", "x", "cl:b"], tx.training_line(F.col("x"), F.lit("L")), "array<string>") == "cl:a cl:b L"
    assert one(spark, 65, tx.next_power_of_two(F.col("x")), "int") == 128
    assert one(spark, "abxb", p.answers_question(F.col("x"), ["b*b"])) is True
    assert one(spark, "abxb", p.answers_question(F.col("x"), ["b*b"], skip_final=True)) is False


def test_repeats_and_frames(spark):
    df = spark.createDataFrame([(2,), (0,), (3,), (-1,)], "d int")
    assert t.repeat_rows(df, F.col("d")).count() == 5
    x = [float(i) for i in range(8)]
    frames = one(spark, x, t.overlapping_frames_of(F.col("x"), 4, 2), "array<double>")
    assert len(frames) == 4 and frames[0] == [0.0] * 4 and frames[-1] == [2.0, 3.0, 4.0, 5.0]
    assert one(spark, x[:5], t.frames_of(F.col("x"), 3), "array<double>") == [[0.0, 1.0, 2.0], [3.0, 4.0, 0.0]]
    assert one(spark, [], t.frames_of(F.col("x"), 3), "array<double>") == []


def test_spans(spark):
    got = t.word_spans(spark.createDataFrame([(1, "ab, é_1  x")], "doc_id long, text string")).collect()
    assert [(r["word"], r["start"], r["stop"]) for r in got] == [("ab", 0, 2), ("é_1", 4, 7), ("x", 9, 10)]


def test_byte_order_marks(spark):
    rows = [(n, mark + "aé".encode(n)) for n, mark in (("UTF-8", b"\xef\xbb\xbf"), ("UTF-16LE", b"\xff\xfe"), ("UTF-16BE", b"\xfe\xff"), ("UTF-32LE", b"\xff\xfe\0\0"), ("UTF-32BE", b"\0\0\xfe\xff"))]
    got = spark.createDataFrame([*rows, (None, b"plain")], "n string, c binary").select("n", src.encoding_of(F.col("c")).alias("e"), src.decoded(F.col("c")).alias("t")).collect()
    assert all(r["n"] == r["e"] for r in got) and {r["t"] for r in got} == {"aé", "plain"}


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿one\n# no\ntwo\n")
    assert [r["value"] for r in src.read_lines(spark, str(tmp_path / "a.txt"), comments=True).collect()] == ["one", "two"]
    for name in ("u1.wav", "u1.lab", "u2.wav", "u3.lab", "u1.f0"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["stem"] for r in src.complete_files(spark, str(tmp_path), "wav", ("lab", "f0")).collect()] == ["u1"]
    assert {r["extension"]: r["n"] for r in src.file_counts(spark, str(tmp_path), ("wav", "lab")).collect()} == {"wav": 2, "lab": 2}

    def rows(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    assert src.read_monophones(rows("0 1500000 a")).first().asDict() == {"start": 0, "stop": 30, "phone": "a"}
    label = src.read_full_labels(rows("0 1500000 x^y-a+b=c/A:1/B:2")).first()
    assert (label["phone"], label["stop_ms"], label["duration_ms"]) == ("a", 150, 150)
    units = src.read_units(rows("f\ta\t10\t15", "f\t#x\t5\t10", "f\tb\t15\t20")).orderBy("start").collect()
    assert [(r["phone"], r["file_start"]) for r in units] == [("a", 5), ("b", 10)]
    assert [tuple(r) for r in src.read_word_tags(rows("w A 2 B 3")).collect()] == [("w", "A", 2), ("w", "B", 3)]
    assert [tuple(r) for r in src.read_transitions(rows("_ A 0.5 B 0.5")).collect()] == [("_", "A", 0.5), ("_", "B", 0.5)]
    tags = spark.createDataFrame([("Nc", "N")], "msd string, tag string")
    assert sorted(tuple(r) for r in src.read_lexicon(rows("a = Nc", "b c X"), tags).collect()) == [("a", "a", "N"), ("b", "c", "X")]
    assert rows(" 1  2.5 ").select(src.floats_of(F.col("value")).alias("x")).first()["x"] == [1.0, 2.5]
    assert src.read_training_rows("A f1 f2\nB f3\n\nC f4\n\n\nD x") == [(0, 0, "A", ["f1", "f2"]), (0, 1, "B", ["f3"]), (1, 0, "C", ["f4"])]
    assert src.read_sections("NONTERM:\nA\nRULES:\n# c\nA -> '<B>'") == {"NONTERM": ["A"], "RULES": ["A -> '<B>'"]}


def test_labels_of_a_sentence(spark):
    rows = [(1, 0, 0, "Hello", ["hel", "lo"], [1, 0], [["h", "e", "l"], ["l.o"]]), (1, 0, 1, "!", ["!"], [0], [["pau"]]), (2, 0, 0, "a", ["a"], [0], [["a"]])]
    df = spark.createDataFrame(rows, "doc_id long, sent_id long, pos long, word string, syllables array<string>, stress array<int>, phones array<array<string>>")
    got = {(r["doc_id"], r["phone_no"]): r["label"] for r in full_labels(df).collect()}
    assert len(got) == 7 + 2
    assert got[1, 0].startswith("#^pau-h+e=l/SYLPOS:start/PHPOS:1/NPIS:3/STRESS:1/PREVSTRESS:0/NEXTSTRESS:0/PREVMARK:sent_start")
    assert got[1, 3].startswith("e^l-l+o=pau/SYLPOS:end/PHPOS:1/NPIS:2/STRESS:0/PREVSTRESS:1/NEXTSTRESS:-1")
    assert all("/TYPE:e/TWORDS:3/TSYL:2/TSTRESS:1" in v for (d, _), v in got.items() if d == 1)
    assert got[2, 1].startswith("pau^a-pau+#=#")
