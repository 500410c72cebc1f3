"""Encoding and decoding with SentencePiece models on the tokenizers library."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabloom.llm.common import id_and_text, map_arrow

MARK = "▁"                   # stands for a space
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6      # fixed values: kinds of pieces in the model file
UNIGRAM, BPE = 1, 2                              # fixed values: kinds of models in the model file
THREADS = 2
REMEMBERED = 1 << 17          # parts after which a worker forgets those it has not met since the last time
REMEMBERED_CHARS = 1 << 21    # and their characters
SLICE_BYTES = 1 << 18         # text that is cut into parts at a time; a longer text stands alone
BLOCK_PARTS = 1 << 13         # new parts encoded at a time: what the libraries return takes a hundred times their text
BLOCK_CHARS = 1 << 17         # and their characters; a longer part stands alone
PROBES = ["", " ", "  two  spaces  ", "\ta\n\nb\r\n", "café 日本語 \U0001f600 à́", "x" * 70,
          "<s> </s> <unk> <0x41>", "1234567890 3.14", f"{MARK}a{MARK}{MARK} b", " 　​\x00"]


def _runs(sizes: Sequence[int], most: int, rows: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of at most ``rows`` items that together have at most ``most``; a larger item is alone."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and (total + size > most or k - start >= rows):
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _blocks(parts: list[str]) -> Iterator[list[str]]:
    """The parts in blocks bounded by number and characters."""
    for a, b in _runs([len(p) for p in parts], BLOCK_CHARS, BLOCK_PARTS):
        yield parts[a:b]


class Pieces:
    """A SentencePiece model (byte pairs or unigram) rebuilt from its protobuf."""

    def __init__(self, path: str, threads: int = THREADS):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer, models

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.model, self.threads = model, threads
        self.names = [p.piece for p in model.pieces]
        kinds = [p.type for p in model.pieces]
        rule, trained = model.normalizer_spec, model.trainer_spec
        if trained.treat_whitespace_as_suffix or not rule.escape_whitespaces or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} uses marks that this reader doesn't know")
        self.normaliser = self._normaliser(rule)
        self.tokenizer = Tokenizer(self._segmenter(trained, kinds))
        self.byte_ids = None          # where a model that scores pieces falls back to bytes: the id of each byte
        if trained.model_type == UNIGRAM and trained.byte_fallback:
            self.byte_ids = {int(n[1:-1], 16): i for i, (n, k) in enumerate(zip(self.names, kinds)) if k == BYTE}
        self.unknown = trained.unk_id
        names = models.WordLevel({n: i for i, n in enumerate(self.names)}, self.names[trained.unk_id])
        self.outer, self.inner = Tokenizer(names), Tokenizer(names)     # decode texts and, without stripping, their parts
        self.outer.decoder, self.inner.decoder = self._decoder(rule), self._decoder(rule, strip=False)
        self.collapses = rule.remove_extra_whitespaces
        # Where no piece goes on after a space, texts fall apart before every space that follows another character.
        crossing = re.compile(f"[^{MARK}]{MARK}")
        self.parts = None if any(crossing.search(n) for n in self.names) else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.prefix = rule.add_dummy_prefix
        self.plain = sentencepiece.SentencePieceProcessor(model_file=path)
        self.identity = (MARK if self.prefix else "") if not (rule.precompiled_charsmap or rule.remove_extra_whitespaces) else None
        self._met: dict[str, bytes] = {}     # ids of the parts met lately
        self._older: dict[str, bytes] = {}   # and of those met before
        self._chars = 0                      # of the parts met lately
        self._odd: set[str] = set()          # parts that sentencepiece encodes otherwise
        self._told: dict[str, str] = {}      # decoded text of the parts whose pieces don't spell them
        self.skipped = {i for i, k in enumerate(kinds) if k == CONTROL}
        # what a piece adds to a text by itself; others are left to the decoder
        self._spelt = [n if k == NORMAL else "\uffff" for n, k in zip(self.names, kinds)]
        self.verify(PROBES)

    @staticmethod
    def _normaliser(rule):
        from tokenizers import Regex, normalizers

        steps = [normalizers.Precompiled(rule.precompiled_charsmap)] if rule.precompiled_charsmap else []
        if rule.remove_extra_whitespaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps.append(normalizers.Replace(" ", MARK))
        if rule.add_dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        return normalizers.Sequence(steps)

    def _segmenter(self, trained, kinds: Sequence[int]):
        from tokenizers import models

        scores = [p.score for p in self.model.pieces]
        if trained.model_type == UNIGRAM:
            # a text may hold the names of bytes and control pieces, which are not pieces of it; bytes are put in by _ids
            apart = [n if kinds[k] == NORMAL else f"\uffff{k}" for k, n in enumerate(self.names)]
            return models.Unigram(list(zip(apart, scores)), trained.unk_id, False)
        if trained.model_type != BPE:
            raise ValueError("only byte-pair and unigram models are known")
        vocabulary = {n: i for i, n in enumerate(self.names)}
        usable = {n for n, k in zip(self.names, kinds) if k == NORMAL}
        merges = []
        for number, name in enumerate(self.names):
            if name in usable:
                halves = [(name[:k], name[k:]) for k in range(1, len(name)) if name[:k] in usable and name[k:] in usable]
                merges += [(-scores[number], number, h) for h in halves]
        merges.sort(key=lambda m: m[:2])
        return models.BPE(vocabulary, [m[2] for m in merges], unk_token=self.names[trained.unk_id], fuse_unk=True,
                          byte_fallback=trained.byte_fallback)

    @staticmethod
    def _decoder(rule, strip: bool = True):
        from tokenizers import decoders

        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        if rule.add_dummy_prefix and strip:
            steps.append(decoders.Strip(" ", 1 << 20 if rule.remove_extra_whitespaces else 1, 0))
        return decoders.Sequence(steps)

    def normalise(self, text: str) -> str:
        """The text as it is cut into pieces; an empty text stays empty."""
        if not text or self.identity is None:
            return self.normaliser.normalize_str(text) if text else ""
        return self.identity + text.replace(" ", MARK)

    def encode(self, texts: Sequence[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of every text, and whether the sentencepiece library gives the same.

        Distinct parts that the worker hasn't met yet are encoded in bounded blocks on several threads, and by the
        sentencepiece library too.
        """
        return self.encode_parts(self.cut(texts))

    def cut(self, texts: Sequence[str]) -> list[list[str]]:
        """The parts of every normalised text, which are encoded one by one."""
        return [[n] if self.parts is None and n else self.parts.findall(n) if n else [] for n in map(self.normalise, texts)]

    def encode_parts(self, cut: Sequence[list[str]]) -> tuple[list[np.ndarray], list[bool]]:
        """What ``encode`` gives for texts that are cut already."""
        if len(self._met) > REMEMBERED or self._chars > REMEMBERED_CHARS:
            self._older, self._met, self._chars = self._met, {}, 0
            for kept in (self._odd, self._told):
                for part in [p for p in kept if p not in self._older]:
                    kept.discard(part) if kept is self._odd else kept.pop(part)
        met, older, odd = self._met, self._older, self._odd
        new = list(set(chain.from_iterable(cut)).difference(met))
        self._chars += sum(map(len, new))
        if older:
            known = [p for p in new if p in older]
            met.update(zip(known, map(older.__getitem__, known)))
            new = [p for p in new if p not in older]
        for block in _blocks(new):
            self._learn(block)
        return ([np.frombuffer(b"".join(map(met.__getitem__, c)), dtype=np.int32) for c in cut],
                [not odd or odd.isdisjoint(c) for c in cut])

    def _learn(self, new: list[str]) -> None:
        """Remembers the ids of parts, which of them sentencepiece encodes otherwise, and what odd ones decode to."""
        ids = self._ids(new)
        self._odd.update(new[k] for k in self._differing(new, ids))
        self._met.update((part, array("i", i).tobytes()) for part, i in zip(new, ids))
        spelt = self._spelt.__getitem__
        open_ = [k for k, (part, i) in enumerate(zip(new, ids)) if "".join(map(spelt, i)) != part]
        if open_:
            rows = [[i for i in ids[k] if i not in self.skipped] for k in open_]
            for k, text in zip(open_, self.inner.decode_batch(rows, skip_special_tokens=False)):
                if text != new[k].replace(MARK, " "):
                    self._told[new[k]] = text

    def _ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of every part; what is unknown to a model that scores pieces becomes bytes where it has them."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        if self.byte_ids is not None:
            for k, row in enumerate(ids):
                if self.unknown in row:
                    e = self.tokenizer.encode(parts[k], add_special_tokens=False)
                    ids[k] = [j for i, (a, b) in zip(e.ids, e.offsets) for j in (
                        [self.byte_ids[x] for x in parts[k][a:b].encode("utf-8")] if i == self.unknown else [i])]
        return ids

    def round_trips(self, texts: Sequence[str], cut: Sequence[list[str]]) -> list[bool]:
        """Whether the ids of every text, as ``encode_parts`` just gave them, decode to the text itself.

        Pieces that spell a part decode to it, with spaces for the marks. Every other part was decoded from its ids.
        """
        told, found = self._told, []
        for text, parts in zip(texts, cut):
            plain = not told or told.keys().isdisjoint(parts)
            if plain and self.identity is not None:
                found.append(MARK not in text)          # nothing but spaces was changed on the way in
                continue
            decoded = "".join([told[p] if p in told else p.replace(MARK, " ") for p in parts])
            if self.prefix:
                decoded = decoded.lstrip(" ") if self.collapses else decoded.removeprefix(" ")
            found.append(decoded == text)
        return found

    def _differing(self, parts: list[str], ids: list[list[int]]) -> list[int]:
        """Numbers of the parts that the sentencepiece library encodes otherwise."""
        # it puts its own mark in front, so a part gives up the one it has
        chosen = [k for k, p in enumerate(parts) if len(p) > self.prefix and (not self.prefix or p.startswith(MARK))]
        expected = self.plain.encode([parts[k][self.prefix:] for k in chosen], num_threads=self.threads)
        return [k for k, e in zip(chosen, expected) if e != ids[k]]

    def verify(self, texts: Sequence[str]) -> None:
        """Raises ``ValueError`` unless whole texts encode and decode as with the sentencepiece library."""
        ids = [i.tolist() for i in self.encode(texts)[0]]
        for text, own, other in zip(texts, ids, self.plain.encode(list(texts))):
            if own != other or self.decode([own])[0] != self.plain.decode(other):
                raise ValueError(f"{text!r} gives {own}, sentencepiece gives {other}")

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """Texts of the ids, without control pieces; pieces of bytes that are no UTF-8 become replacement characters."""
        kept = [[i for i in row if i not in self.skipped] for row in ids]
        return self.outer.decode_batch(kept, skip_special_tokens=False)


_models: dict[str, Pieces] = {}      # one per worker and file


def _load(path: str, threads: int) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path, threads)
    return _models[path]


def encode_documents(docs: DataFrame, model: str, threads: int = THREADS, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens``, ``round_trip`` (the ids decode to the text) and ``parity`` of every document.

    ``model`` is the path of a SentencePiece model file, readable on every executor. Normaliser, space marks, scores or
    merges and byte fallback are rebuilt on the tokenizers library, which encodes each batch on ``threads`` threads.
    Texts are cut before spaces where no piece of the model crosses them, and distinct parts are encoded once while the
    worker remembers them; every part is verified against the sentencepiece library. Where the two differ, ``parity``
    is false. A part is decoded in the same pass: pieces that spell it stand for it, all others go through the rebuilt
    decoder; a text that the model changes, or that holds the mark of a space itself, has no ``round_trip``.

    Documents are independent: one pass, no shuffle. A batch is worked on in slices and its new parts in blocks, both
    bounded by text, so a worker holds the model, the parts it remembers and a slice, or one longer text. NULL text
    counts as empty and gives no ids. NULL ids and repeated rows are returned as they are. An empty table gives an empty
    result.
    """
    rows = id_and_text(docs, id_column, text_column)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model, threads)
        for whole in batches:
            lengths = pc.binary_length(whole["text"]).to_pylist()
            for start, end in _runs(lengths, SLICE_BYTES, len(lengths)):
                batch = whole.slice(start, end - start)
                texts = batch["text"].to_pylist()
                cut = pieces.cut(texts)
                ids, agreed = pieces.encode_parts(cut)
                same = pieces.round_trips(texts, cut)
                sizes = np.array([len(i) for i in ids], dtype=np.int64)
                flat = np.concatenate(ids)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(sizes),
                     pa.array(same, pa.bool_()), pa.array(agreed, pa.bool_())],
                    ["doc_id", "ids", "n_tokens", "round_trip", "parity"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows, encode, f"doc_id {kind}, ids array<int>, n_tokens bigint, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, model: str, threads: int = THREADS) -> DataFrame:
    """``doc_id`` and ``text`` of a table with ``doc_id`` and ``ids``; NULL ids count as none and give an empty text."""
    rows = encoded.select("doc_id", "ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _load(model, threads)
        for batch in batches:
            texts = pieces.decode([i or [] for i in batch["ids"].to_pylist()])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(rows, decode, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
