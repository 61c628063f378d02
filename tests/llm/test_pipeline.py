"""The pipeline's stages on odd and real rows, each against brute force, and the whole run."""

import re
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_text_operators import WORD, brute_links
from weftline.llm import bpe
from weftline.llm.mixing import targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, small):
    real = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    rows = [(9001, None, "en", "s", 0), (9002, "", None, None, None), (9003, "12 34", None, "s", 5), (9004, "The the of and", None, None, 14), (9005, "the THE of and", None, None, 14), (9005, "the THE of and", None, None, 14), (None, "the  of\tand", None, "s", 3), (None, "the of and", None, "s", 3)]
    return real.unionByName(spark.createDataFrame(rows, SCHEMA))


def key(r):
    return (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", str(r["source"]))


def test_stages(spark, docs):
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language_id"](spark, docs, "")
    assert kept.columns == docs.columns
    want = [r for r in docs.collect() if re.search(r"[^\W\d_]", r["text"] or "")]
    assert sorted(kept.collect(), key=key) == sorted(want, key=key)

    unique = stage["exact_dedup"](spark, kept, "")
    assert unique.columns == docs.columns
    least = {}
    for r in want:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        if norm not in least or key(r)[:2] < key(least[norm])[:2]:
            least[norm] = r
    got = unique.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == sorted(key(r)[:2] for r in least.values())
    assert len({re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]) for r in got}) == len(got)

    apart = stage["near_dedup"](spark, unique, "")
    stays = [i for i, n, component, _ in brute_links([(r["doc_id"], r["text"]) for r in got]) if i == component or not n]
    assert sorted(map(str, (r["doc_id"] for r in apart.collect()))) == sorted(map(str, stays))
    assert apart.columns == docs.columns

    mixed = stage["source_mix"](spark, apart, "")
    assert mixed.columns == docs.columns
    rows = apart.collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed.collect():
        taken[r["source"]] += len(WORD.findall(r["text"]))
    largest = max(len(WORD.findall(r["text"])) for r in rows)
    for s, aim in targets(dict(sizes), (5, 2, 1), 1.5, 2.0).items():
        assert abs(taken[s] - aim) <= largest
    assert max(Counter(map(key, mixed.collect())).values()) <= 2

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    counts = sorted((str(r["doc_id"]), len(enc.encode_ordinary(r["text"]))) for r in mixed.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in stage["byte_bpe"](spark, mixed, "").collect()) == counts


def test_run_and_empty_table(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 100
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_extra_columns_with_clashing_names(spark, docs):
    names = ("lang_pred", "score", "doc", "key", "sha", "size", "place", "shards", "n_shingles", "component_id", "salt", "recipe", "a.b")
    extra = docs.limit(40).selectExpr("*", *(f"'x' AS `{n}`" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, extra, "")
        assert out.columns == extra.columns, name
        assert out.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, extra, "").count() == 40
