"""SentencePiece on the tokenizers library against the sentencepiece library."""

import io
import random
from array import array

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tabloom.llm.pieces import PROBES, Pieces, decode_documents, encode_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(9)
    alphabet = "abcdeé  \n\t日▁\U0001f600.,<>s/0xZ"
    return PROBES + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)]


def test_ids_and_text():
    pieces, plain = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids, agreed = pieces.encode(texts())
    want = plain.encode(texts())
    assert [i.tolist() for i in ids] == want and all(agreed)
    assert pieces.decode(want) == plain.decode(want)
    assert pieces.decode([[1, *want[4], 2]]) == [plain.decode([1, *want[4], 2])]


def test_differences_are_reported():
    pieces = Pieces(PATH)
    broken = pieces.tokenizer.encode_batch_fast

    class Off:
        def encode_batch_fast(self, parts, add_special_tokens):
            from types import SimpleNamespace
            return [SimpleNamespace(ids=[5] if p == "▁zebra" else e.ids)
                    for p, e in zip(parts, broken(parts, add_special_tokens=add_special_tokens))]
    pieces.tokenizer = Off()
    rows = ["a zebra", "a b", "zebra"]
    ids, agreed = pieces.encode(rows)
    assert agreed == [False, True, False] and ids[2].tolist() == [5]
    assert pieces.round_trips(rows, pieces.cut(rows)) == [False, True, False]      # the operator's own ids are judged


def test_parts_decode_as_by_the_library(folder):
    """Every part of the documents, whether its pieces spell it or not, with a worker that forgets all the time."""
    import pyarrow.parquet as pq

    from tabloom.llm import pieces as module
    pieces = Pieces(PATH)
    A = pieces.names.index("a")
    rows = [t or "" for t in pq.read_table(f"{folder}/documents.parquet")["text"].to_pylist()] + texts()
    limit, module.REMEMBERED = module.REMEMBERED, 500
    try:
        for k in range(0, len(rows), 50):
            cut = pieces.cut(rows[k:k + 50])
            ids, agreed = pieces.encode_parts(cut)
            assert all(agreed)
            decoded = pieces.plain.decode([i.tolist() for i in ids])
            assert pieces.round_trips(rows[k:k + 50], cut) == [d == t for d, t in zip(decoded, rows[k:k + 50])]
            for part in set().union(*cut):
                own = array("i", pieces._met[part]).tolist()
                text = pieces._told.get(part, part.replace(module.MARK, " "))
                assert pieces.inner.decode(own, skip_special_tokens=False) == text
                assert pieces.plain.decode([A, *own]) == pieces.plain.decode([A]) + text
    finally:
        module.REMEMBERED = limit


def unigram_model(path):
    """A small hand-made unigram model with byte fallback, spaces between words kept as one."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        source = sentencepiece_model_pb2.ModelProto()
        source.ParseFromString(f.read())
    model.trainer_spec.CopyFrom(source.trainer_spec)
    model.trainer_spec.model_type = 1
    model.normalizer_spec.CopyFrom(source.normalizer_spec)
    model.normalizer_spec.remove_extra_whitespaces = True
    for piece in source.pieces:
        if piece.type != 1:
            model.pieces.add().CopyFrom(piece)
    for k, name in enumerate(["▁", "▁th", "the", "▁the", "a", "b", "ab", "ba", "aba", "e", "h", "t", "c", "abc"]):
        model.pieces.add(piece=name, score=-1.0 - 0.37 * k, type=1)
    model.trainer_spec.vocab_size = len(model.pieces)
    with io.open(path, "wb") as f:
        f.write(model.SerializeToString())


def test_unigram(tmp_path):
    path = str(tmp_path / "u.model")
    unigram_model(path)
    pieces, plain = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(3)
    rows = ["".join(rng.choice(["a", "b", "t", "h", "e", "c", " ", " ", "z", "日", "<0x41>", "<unk>", "<s>"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    assert [i.tolist() for i in pieces.encode(rows)[0]] == plain.encode(rows)


def test_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    encoded = encode_documents(docs, PATH)
    rows = {r.doc_id: r for r in encoded.collect()}
    original = {r.doc_id: r.text for r in docs.collect()}
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for i, text in original.items():
        assert rows[i].ids == plain.encode(text) and rows[i].n_tokens == len(rows[i].ids) and rows[i].round_trip
    assert {r.doc_id: r.text for r in decode_documents(encoded, PATH).collect()} == original


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "a", "x"), (None, "a", "x"), (2, "", "x"), (3, "word " * 100_000, "x")],
                                 "doc_id bigint, text string, ids string")
    rows = encode_documents(docs, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows)[:4] == [(0, 1), (0, 1), (1, 0), (2, 0)]
    assert all(r.round_trip for r in rows)
    assert encode_documents(docs.where("false"), PATH).count() == 0
    empty = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [r.text for r in decode_documents(empty, PATH).collect()] == ["", ""]


def test_round_trip_is_decoding(spark, tmp_path):
    path = str(tmp_path / "u.model")
    unigram_model(path)
    rows = texts() + ["a\u2581b", " \u2581", "a  b", " a", "<unk>"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    for model in (PATH, path):
        plain = sentencepiece.SentencePieceProcessor(model_file=model)
        got = {r.doc_id: (list(r.ids), r.round_trip) for r in encode_documents(docs, model).collect()}
        assert {i: same for i, (_, same) in got.items()} == {i: plain.decode(got[i][0]) == t for i, t in enumerate(rows)}
        assert not got[len(texts())][1]


def test_new_parts_are_encoded_in_bounded_blocks():
    from tabloom.llm import pieces as module
    pieces, plain = Pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    fast, handed = pieces.tokenizer.encode_batch_fast, []

    class Noted:
        def encode_batch_fast(self, parts, add_special_tokens):
            handed.append(list(parts))
            return fast(parts, add_special_tokens=add_special_tokens)
    pieces.tokenizer = Noted()
    rng = random.Random(4)
    long = "".join(rng.choice("abcde") for _ in range(2 * module.BLOCK_CHARS))
    rows = [" ".join(f"{rng.randrange(1 << 40):x}" for _ in range(6000)) for _ in range(5)] + [long, "a b"]
    ids, agreed = pieces.encode(rows)
    assert [i.tolist() for i in ids] == plain.encode(rows) and all(agreed)
    assert max(map(len, handed)) <= module.BLOCK_PARTS
    assert all(sum(map(len, h)) <= module.BLOCK_CHARS or len(h) == 1 for h in handed)
    assert len(pieces._met) > 30_000      # all were met, in several blocks
    pieces.encode([long[1:]])             # many characters, though few parts, are forgotten as well
    for k in range(8):
        pieces.encode([f"{k}{long}"])
    assert max(pieces._chars, sum(map(len, pieces._met))) <= module.REMEMBERED_CHARS + len(long) + 2


def test_batches_are_cut_in_slices(spark, tmp_path):
    """Batches are cut by text: what a worker is handed at a time doesn't grow with the batch."""
    from tabloom.llm import pieces as module
    rng = random.Random(5)
    words = ["".join(rng.choice("abcde日") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 800))) for _ in range(600)]
    rows[300] = " ".join(rng.choice(words) for _ in range(module.SLICE_BYTES // 3))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").coalesce(1)
    seen = str(tmp_path / "seen")
    cut = Pieces.cut

    def noted(self, texts):
        with open(seen, "a") as f:
            f.write(f"{len(texts)} {sum(len(t.encode()) for t in texts)}\n")
        return cut(self, texts)

    def load(path, threads):
        pieces = Pieces(path, threads)
        pieces.cut = noted.__get__(pieces)
        return pieces
    kept, encode = module.map_arrow, []
    module.map_arrow = lambda df, work, schema: encode.append(work) or df
    try:
        encode_documents(docs, PATH)
    finally:
        module.map_arrow = kept
    kept, module._load = module._load, load
    try:
        out = [b for b in encode[0](iter(docs.toArrow().to_batches()))]
    finally:
        module._load = kept
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    assert [i for b in out for i in b["doc_id"].to_pylist()] == list(range(len(rows)))
    assert [i for b in out for i in b["ids"].to_pylist()] == plain.encode(rows)
    handed = [tuple(map(int, x.split())) for x in open(seen)]
    assert len(handed) > 3 and all(size <= module.SLICE_BYTES or n == 1 for n, size in handed)
    assert any(size > module.SLICE_BYTES for n, size in handed)
