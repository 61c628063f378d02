"""Texts and payloads of several MB, larger than the parts that tasks work in."""

import hashlib
import re
import zlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from weftline.llm import bpe, token_counts
from weftline.llm.exact_dedup import exact_groups
from weftline.llm.mixing import mix_sources
from weftline.llm.secrets import secret_scan
from weftline.llm.sharding import shard_documents
from weftline.llm.warc import warc_archive

LONG = "".join(f"word{i % 977} {'é' * (i % 5)} x{i * i % 10_007}\n" for i in range(150_000)) + "password: hunter2hunter " + "deadbeef" * 6


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG, "s"), (2, LONG.replace("\n", " "), "s"), (3, "short", None), (4, "ab" * 20_000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_long_texts(docs):
    assert len(LONG) > 2 << 20
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    groups = {r["doc_id"]: r for r in exact_groups(docs).collect()}
    assert (groups[2]["keep_id"], groups[1]["group_size"], groups[4]["kept"]) == (1, 2, True)
    assert groups[1]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", LONG).encode()).hexdigest()
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    for r in bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect():
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert counts == {i: len(tok.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    spans = {r["doc_id"]: r for r in secret_scan(docs).collect()}
    assert (spans[1]["n_assign"], spans[1]["n_hex"], spans[3]["spans"]) == (1, 1, "") and f"hex:{len(LONG) - 48}:{len(LONG)}" in spans[1]["spans"]
    words = {r["doc_id"]: r["size"] for r in mix_sources(docs).collect()}
    assert words == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert {(r["doc_id"], r["text_crc32"]) for r in shard_documents(docs).collect()} == {(i, zlib.crc32(t.encode())) for i, t in texts.items()}


def test_payloads_larger_than_a_frame(spark):
    pages = [(1, "u", LONG), (2, "u", LONG), (3, "u", "tiny"), (4, "u", LONG + "!")]
    got = {r["page_id"]: r for r in warc_archive(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i]["record_type"] for i in (1, 2, 3, 4)] == ["response", "revisit", "response", "response"] and got[2]["refers_to"] == 1
    assert all(got[i]["payload_digest"] == hashlib.sha256(h.encode()).hexdigest() and got[i]["payload_bytes"] == len(h.encode()) for i, _, h in pages)
