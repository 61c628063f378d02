"""Language identification: held-out accuracy, whole-text scores by hand, odd rows."""

import math
import zlib
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from weftline.llm.language import Model, identify_languages, train, training_rows

ROWS = [("a", "the cat the dog"), ("a", "cat sat"), ("b", "der hund der die"), ("b", "hund"), ("b", "zoo")]


def test_held_out_accuracy(spark, small):
    df = spark.read.parquet(f"{small.replace('0.001', '0.01')}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in df.collect()}
    got = identify_languages(df).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_known_words_score_by_frequency_and_others_by_their_longest_known_ngrams():
    model = train(ROWS, least=1)
    words = {w for _, t in ROWS for w in t.split()}
    n_words = len(words)
    a = math.log((2 + 0.5) / (6 + 0.5 * (n_words + 1)))
    b = math.log((0 + 0.5) / (6 + 0.5 * (n_words + 1)))
    assert model.scores("THE, 12", {})[0] == pytest.approx(a) and model.scores("the", {})[1] == pytest.approx(b)
    for word in ("cats", "hunde", "qqzooqq", "tqqh", "q"):
        padded = f"<{word}>"
        for n in (4, 3, 2, 1):
            source = padded if n > 1 else word
            found = [model.grams[n - 1][source[i : i + n]] for i in range(len(source) - n + 1) if source[i : i + n] in model.grams[n - 1]]
            if found:
                assert model.backoff(word) == pytest.approx(model.table[found].mean(0))
                break
        else:
            assert model.backoff(word) is None
    assert model.predict("hunde zoos")[0] == "b" and model.predict("cats")[0] == "a"


def test_undetermined_and_ties():
    model = train(ROWS, least=1)
    assert [model.predict(x) for x in (None, "", "12 _ !", "½ ② ² Ⅷ", "\u0301")] == [("und", 0.0)] * 5
    assert model.predict("qqq") == ("a", 0.5)
    assert train([]).predict("words") == ("und", 0.0)
    assert isinstance(model, Model) and train(ROWS, least=3).scores("the dog", {}) is not None


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, held_out string, score string"
    rows = [(i, t, lang, None, "x", "y") for i, (lang, t) in enumerate([("en", "the cat"), ("de", "der hund"), (None, "cat"), ("en", None), ("en", ""), ("en", "1 2"), ("zz", None)] * 3)]
    rows += [(1, "the cat " * 50_000, "en", None, None, None), (1, "the cat", "en", None, None, None), (None, "der hund", "de", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got} == {"en", "de", "und"}
    assert sum(r["lang_pred"] == "und" for r in got) == 12
    assert identify_languages(df.limit(0)).collect() == []
    assert {r["lang_pred"] for r in identify_languages(df.filter("lang is null")).collect()} == {"und"}


def slow_model(rows, least=2):
    """Log frequencies of what is known, by kind (0: words, n: n-grams), straight from the definition."""
    langs = sorted({x for x, _ in rows})
    counts = [{x: Counter() for x in langs} for _ in range(5)]
    for lang, text in rows:
        for word in regex.findall(r"\p{L}+", text.lower()):
            counts[0][lang][word] += 1
            for n in range(1, 5):
                source = f"<{word}>" if n > 1 else word
                counts[n][lang].update(source[i : i + n] for i in range(len(source) - n + 1))
    tables = []
    for of in counts:
        every = set().union(*of.values())
        total = {x: sum(of[x].values()) for x in langs}
        tables.append({g: [math.log((of[x][g] + 0.5) / (total[x] + 0.5 * (len(every) + 1))) for x in langs] for g in every if sum(of[x][g] for x in langs) >= least})
    return langs, tables


def slow_scores(model, text):
    langs, tables = model
    sums, any_letter = [0.0] * len(langs), False
    for word in regex.findall(r"\p{L}+", (text or "").lower()):
        any_letter = True
        if word in tables[0]:
            found = [tables[0][word]]
        else:
            for n in (4, 3, 2, 1):
                source = f"<{word}>" if n > 1 else word
                found = [tables[n][source[i : i + n]] for i in range(len(source) - n + 1) if source[i : i + n] in tables[n]]
                if found:
                    break
        for k in range(len(langs)):
            sums[k] += sum(x[k] for x in found) / len(found) if found else 0.0
    return sums if any_letter else None


def test_whole_predictions_against_brute_force(spark, small):
    real = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10_001, "½ ② ² Ⅷ", "en"), (10_002, "Ⅷ the", None), (10_003, None, "fr"), (10_004, "der " * 30_000, None), (None, "la casa", "es")], real.schema)
    df = real.union(odd)
    rows = [tuple(r) for r in df.collect()]
    fitted = [(lang, t) for i, t, lang in rows if t is not None and lang is not None and not (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)]
    model = slow_model(fitted)
    scores = {(i, t): slow_scores(model, t) for i, t, _ in rows}
    got = {r["doc_id"]: r for r in identify_languages(df).collect()}
    for i, t, _ in rows:
        s = scores[i, t]
        if s is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        best = max(s)
        assert s[model[0].index(got[i]["lang_pred"])] == pytest.approx(best, abs=1e-6 * abs(best) + 1e-9)
        assert got[i]["score"] == pytest.approx(1 / sum(math.exp(x - best) for x in s), abs=1e-6)


def test_sample_is_bounded_and_whole_texts(spark):
    rows = [(i, "wort " * (i % 50 + 1), "de") for i in range(400)] + [(1000 + i, "word " * 3, "en") for i in range(5)] + [(2000, "x" * 5000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    every = training_rows(df, 1000, F.lit(True))
    assert sorted(every) == sorted((lang, t) for _, t, lang in rows)
    few = training_rows(df, 10, F.lit(True))
    assert Counter(x for x, _ in few) == {"de": 10, "en": 6} and set(few) <= set(every)
    tight = training_rows(df, 1000, F.lit(True), sample_bytes=4000)
    assert sum(len(t) for x, t in tight if x == "de") <= 2000 and Counter(x for x, _ in tight)["en"] == 5


def test_rows_alike_count_against_the_bounds(spark):
    rows = [(1, "the same few words", "en")] * 5000 + [(2, f"der hund {i}", "de") for i in range(300)] + [(None, "null ids too", "fr")] * 400
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = Counter(lang for lang, _ in training_rows(docs, 100, F.lit(True)))
    assert found == {"en": 100, "de": 100, "fr": 100}
    for size in (60, 1000, 3001):
        sample = training_rows(docs, 1000, F.lit(True), sample_bytes=size)
        used = Counter()
        for lang, text in sample:
            used[lang] += len(text.encode())
        assert all(n <= size // 3 for n in used.values()) and sum(used.values()) >= size - 3 * 19
