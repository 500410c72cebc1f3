"""Token counts against the tokenizers library."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tabloom.llm.token_count import TokenCounter, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a<|endoftext|>b<|endoftext|><|endoftext|>", "a" * 5000, "ab" * 3000 + "  \n\n  x", "日本語 " * 50 + "\U0001f600",
         "I'll 've  x\t\ty\r\n z ", "\x00\x01 \xa0　 é", "<|endoftext", " <|endoftext|> x", "=" * 777, " " * 999,
         "The quick brown fox's 12345 tails!!\n\n", "éà", "퟿"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_edges(library):
    counter = TokenCounter(PATH)
    assert [counter.of_text(t) for t in TEXTS] == library(TEXTS)


def test_documents(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, library(list(texts.values()))))
    for r in token_counts(docs, PATH).collect():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), want[r.doc_id], want[r.doc_id] > 512)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, None, 5), (None, "a b", 5), (None, "a b", 5), (2, "", 5), (3, "long " * 200_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    got = sorted((tuple(r) for r in token_counts(docs, PATH, limit=1).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (None, 3, 2, True), (None, 3, 2, True), (2, 0, 0, False), (3, 1_000_000, 200_001, True)], key=str)
    assert token_counts(docs.where("false"), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        TokenCounter(public_tokenizers.path("word_bpe_49k.json"))
