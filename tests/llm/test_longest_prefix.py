"""The longest prefix within a budget, by encoding every prefix."""

import random

import public_tokenizers as P
from tokenizers import Tokenizer

from weftline.llm import token_counts


def test_truncate_gives_the_longest_prefix():
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rng = random.Random(7)
    letters = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(150))
    mixed = ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'ll", "'", "1", "!?", "é", "漢", "🙂", "<|endoftext|>", "ing"]) for _ in range(25)) for _ in range(25)]
    for text in [letters, "x " + letters, "漢字🙂" * 15, "don't'll   we  \n\n go<|endoftext|> on", "internationalization of tokenizers", " " * 40 + "x", "", *mixed]:
        table = token_counts.counter(path, P.PATTERN).table(text)
        counts = [len(tok.encode(text[:n], add_special_tokens=False).ids) for n in range(len(text) + 1)]
        assert [table.count_at(n) for n in range(len(text) + 1)] == counts
        for budget in (0, 1, 2, 3, 5, 8, 13, 30, 1000):
            assert table.truncate(budget) == max(n for n, c in enumerate(counts) if c <= budget)
    assert token_counts.counter(path, P.PATTERN).table(letters).truncate(10) > 10


def test_tables_of_prefixes_and_cut_texts(spark, small):
    path = P.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    rows = [(1, "it's  a\n\n b!!<|endoftext|> 漢字 don't'll"), (2, None), (2, ""), (None, "🙂🙂 naïve"), (3, "internationalization")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, counts string")
    got = sorted(((r["doc_id"], r["counts"]) for r in token_counts.prefix_counts(df, path, P.PATTERN).collect()), key=str)
    assert got == sorted(((i, [count((t or "")[:n]) for n in range(len(t or "") + 1)]) for i, t in rows), key=str)
    real = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    for r in token_counts.truncated(real.union(real.limit(0)), path, P.PATTERN, 64).collect():
        text = {x["doc_id"]: x["text"] for x in real.collect()}[r["doc_id"]]
        assert (r["n_tokens"], r["kept"], r["kept_tokens"]) == (count(text), text[: r["kept_chars"]], count(r["kept"]))
        assert r["kept_tokens"] <= 64 and (r["kept"] == text or all(count(text[:n]) > 64 for n in range(r["kept_chars"] + 1, r["kept_chars"] + 20)))
    assert token_counts.truncated(df.limit(0), path, P.PATTERN, 5).count() == token_counts.prefix_counts(df.limit(0), path, P.PATTERN).count() == 0
