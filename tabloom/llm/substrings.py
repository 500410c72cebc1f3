"""Repeated passages: windows of words meet in buckets as super-k-mers and are compared there by sorting."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_arrow, stored

SEED = 42
SIGNATURE = 3                  # words of a minimiser
LONGEST = 64                   # windows of a super-k-mer; only texts that repeat themselves reach it
BUCKET_BYTES = 1 << 20         # text per bucket, by which the number of buckets is chosen
SPLIT_BYTES = 8 << 20          # windows of a bucket that gets more packed words are dealt by themselves
LOAD_SHARE = 32                # one document in so many is packed first, to see what the buckets get
FLUSH_BYTES = 32 << 20         # packed words that a task gathers before it hands them on
SHARED_WORDS = 60_000          # frequent words that travel as numbers known to all tasks
SAMPLED_BYTES = 16 << 20       # text from which they are picked
PACKED = "bucket bigint, size bigint, data binary"
_CODEC = "zstd"


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _runs_hash(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` values in a row."""
    total = np.zeros(max(0, len(values) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            total = total * np.uint64(0x9E3779B97F4A7C15) + values[k:len(values) - size + 1 + k]
    return _mixed(total)


def _sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """Least of every ``size`` values in a row, by doubling."""
    reach = 1
    while 2 * reach <= size:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[:len(values) - (size - reach)], values[size - reach:]) if size > reach else values


def minimisers(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of words the least hash of ``SIGNATURE`` words in a row inside it (fewer in a shorter window)."""
    size = min(SIGNATURE, window)
    if len(hashes) < window:
        return np.zeros(0, dtype=np.uint64)
    return _sliding_least(_runs_hash(hashes, size), window - size + 1)


def super_kmers(keys: np.ndarray, valid: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every run of valid neighbours with one key and owner, at most ``LONGEST``."""
    places = np.flatnonzero(valid)
    if not len(places):
        return places, places
    chosen = keys[places]
    fresh = np.ones(len(places), dtype=bool)
    fresh[1:] = (np.diff(places) != 1) | (chosen[1:] != chosen[:-1]) | (np.diff(owner[places]) != 0)
    begins = np.flatnonzero(fresh)
    within = np.arange(len(places)) - np.repeat(begins, np.diff(np.append(begins, len(places))))
    begins = np.flatnonzero(within % LONGEST == 0)
    return places[begins], np.diff(np.append(begins, len(places)))


class _Codes:
    """Numbers for words: those of a list that all tasks share come first, others are numbered as they are met."""

    def __init__(self, shared: list[bytes]):
        self.shared = {w: k for k, w in enumerate(shared)}
        self.known = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in shared), dtype=np.uint64, count=len(shared))
        self.forget()

    def forget(self) -> None:
        self.numbers = dict(self.shared)
        self.others: list[bytes] = []
        self.hashes = self.known

    def of(self, words: list[bytes]) -> np.ndarray:
        new = list(set(words).difference(self.numbers))
        if new:
            self.numbers.update(zip(new, range(len(self.hashes), len(self.hashes) + len(new))))
            self.others += new
            more = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in new), dtype=np.uint64, count=len(new))
            self.hashes = np.concatenate([self.hashes, more])
        return np.fromiter(map(self.numbers.__getitem__, words), dtype=np.uint32, count=len(words))


def _transposed(column: np.ndarray) -> bytes:
    """Bytes of the numbers, all first bytes, then all second ones, and so on; they compress better."""
    return column.view(np.uint8).reshape(-1, column.itemsize).T.tobytes()


def _restored(raw: bytes, at: int, n: int, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T.copy().view(kind)[:, 0]


COLUMNS = [np.int64, np.int64, np.int32, np.int32]      # id, hash of the text, place of the first word, words or end


def _pack(columns: list[np.ndarray], codes: np.ndarray | None = None, others: list[bytes] = ()) -> tuple[int, bytes]:
    """Columns, and words as codes; ``others`` are the words of the codes that follow the shared list."""
    codes = np.zeros(0, dtype=np.uint32) if codes is None else codes
    steps = np.diff(columns[0], prepend=0)
    raw = b"".join([np.array([len(steps), len(codes)], dtype=np.int64).tobytes(), *map(_transposed, [steps, *columns[1:]]),
                    _transposed(codes), b" ".join(others)])
    return len(raw), pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpack(size: int, data: bytes) -> tuple[list[np.ndarray], np.ndarray, list[bytes]]:
    raw = pa.decompress(data, decompressed_size=size, codec=_CODEC, asbytes=True)
    n, m = np.frombuffer(raw, np.int64, 2).tolist()
    at, columns = 16, []
    for kind in COLUMNS:
        columns.append(_restored(raw, at, n, kind))
        at += n * np.dtype(kind).itemsize
    columns[0] = np.cumsum(columns[0])
    return columns, _restored(raw, at, m, np.uint32), raw[at + 4 * m:].split()


class _Gatherer:
    """Strings of words on their way to the buckets, held as codes.

    Of equal strings in one go only those of the smallest id travel: for the others it is clear already that a smaller
    id has all their windows, so a passage of any frequency sends one string per task and go.
    """

    def __init__(self, shared: list[bytes]):
        self.codes = _Codes(shared)
        self._clear()

    def _clear(self):
        self.strings: list[bytes] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, ids: np.ndarray, hashes: np.ndarray, places: np.ndarray, buckets: np.ndarray, words: np.ndarray,
            starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """Takes the strings of the ``sizes`` codes from ``starts`` on in ``words``."""
        flat = words.tobytes()
        self.strings += [flat[a:b] for a, b in zip((4 * starts).tolist(), (4 * (starts + sizes)).tolist())]
        self.parts.append((ids, hashes, places.astype(np.int32), sizes.astype(np.int32), buckets))
        self.held += 4 * int(sizes.sum())
        if self.held > FLUSH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, bytes]]:
        if not self.strings:
            return
        ids, hashes, places, sizes, buckets = (np.concatenate(c) for c in zip(*self.parts))
        strings, shared, others = self.strings, len(self.codes.shared), self.codes.others
        self._clear()
        met: dict[bytes, int] = {}
        same = np.fromiter((met.setdefault(w, k) for k, w in enumerate(strings)), dtype=np.int64, count=len(strings))
        del met
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, same, ids)
        late = ids > least[same]
        if late.any():
            spans = _merged(ids[late], hashes[late], places[late], places[late] + sizes[late])
            yield -1 - int(buckets[late][0]), *_pack(spans)
        go = np.flatnonzero(~late)
        go = go[np.argsort(buckets[go], kind="stable")]
        at = buckets[go]
        begins = np.flatnonzero(np.diff(at, prepend=-1))
        for bucket, piece in zip(at[begins].tolist(), np.split(go, begins[1:])):
            codes = np.frombuffer(b"".join([strings[k] for k in piece.tolist()]), dtype=np.uint32).copy()
            rare = codes >= shared
            numbers, codes[rare] = (lambda u, i: (u, i + shared))(*np.unique(codes[rare], return_inverse=True))
            yield bucket, *_pack([c[piece] for c in (ids, hashes, places, sizes)], codes,
                                 [others[k - shared] for k in numbers.tolist()])
        self.codes.forget()


def _merged(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Spans of words with neighbours of one document that touch or overlap joined; they come in order."""
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]) | (first[1:] > end[:-1]) | (first[1:] < first[:-1])
    begins = np.flatnonzero(fresh)
    last = np.append(begins[1:], len(ids)) - 1
    return [ids[begins], hashes[begins], first[begins].astype(np.int32), end[last].astype(np.int32)]


def _packed_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    buckets, sizes, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())],
                                      ["bucket", "size", "data"])


def _in_batches(rows: Iterator[tuple[int, int, bytes]], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > limit:
            yield _packed_batch(held)
            held, size = [], 0
    if held:
        yield _packed_batch(held)


def _cut(batch: pa.RecordBatch, window: int, buckets: int, large: np.ndarray, pieces: int,
         gatherer: _Gatherer) -> Iterator[tuple[int, int, bytes]]:
    """Hands the super-k-mers of the batch's texts to the gatherer; windows of ``large`` buckets one by one."""
    texts = [t.split() for t in batch["text"].cast(pa.binary()).to_pylist()]     # of bytes: at \x20 and \x09-\x0D only
    counts = np.array([len(t) for t in texts], dtype=np.int64)
    if not len(texts) or counts.max() < window:
        return
    codes = gatherer.codes.of(list(chain.from_iterable(texts)))
    del texts
    hashes = gatherer.codes.hashes[codes]
    keys = minimisers(hashes, window)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    valid = (np.arange(len(codes)) + window <= ends[owner])[:len(keys)]
    first, n = super_kmers(keys, valid, owner)
    at = (_mixed(keys[first]) % np.uint64(buckets)).astype(np.int64)
    if len(large):
        apart = np.isin(at, large)
        first, n, at, alone = first[~apart], n[~apart], at[~apart], _stretches(first[apart], n[apart])
        whole = _runs_hash(hashes, window)[alone] % np.uint64(pieces)
        first, n = np.concatenate([first, alone]), np.concatenate([n, np.ones(len(alone), dtype=n.dtype)])
        at = np.concatenate([at, buckets + whole.astype(np.int64)])
    row = owner[first]
    yield from gatherer.add(batch["doc_id"].to_numpy()[row], batch["text_hash"].to_numpy()[row],
                            first - (ends - counts)[row], at, codes, first, n + window - 1)


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ``size`` numbers from ``start`` on of every pair, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def repeated_spans(blobs: list[tuple[int, bytes]], window: int, shared: int) -> list[np.ndarray]:
    """Spans (id, hash, first word, word behind the last) of the windows in a bucket that a smaller id has too.

    Windows are sorted by a hash of their words. Those that share it are compared word by word before they count as equal.
    Codes below ``shared`` stand for the same word in all blobs; the others are numbered anew.
    """
    numbers: dict[bytes, int] = {}
    parts, texts = [], []
    for columns, codes, others in (_unpack(*b) for b in blobs):
        parts.append(columns)
        if others:
            own = np.fromiter((numbers.setdefault(w, shared + len(numbers)) for w in others), dtype=np.uint32, count=len(others))
            rare = codes >= shared
            codes[rare] = own[codes[rare] - shared]
        texts.append(codes)
    ids, hashes, places, sizes = (np.concatenate(c) for c in zip(*parts))
    codes = np.concatenate(texts)
    del parts, texts
    ends = np.cumsum(sizes.astype(np.int64))
    starts = ends - sizes
    owner = np.repeat(np.arange(len(ids)), sizes)
    valid = np.flatnonzero(np.arange(len(codes)) + window <= ends[owner])
    names = _mixed(codes.astype(np.uint64) + np.uint64(1))
    key = _runs_hash(names, window)[valid]
    order = np.argsort(key, kind="stable")
    group = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
    at = valid[order]
    doc = ids[owner[at]]
    begins = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    least, most = np.minimum.reduceat(doc, begins), np.maximum.reduceat(doc, begins)
    shared = (least != most)[group]
    at, group, doc = at[shared], group[shared], doc[shared]
    if not len(at):
        return [np.zeros(0, dtype=k) for k in COLUMNS]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    head = np.repeat(heads, np.diff(np.append(heads, len(at))))
    if any((codes[at + k] != codes[at[head] + k]).any() for k in range(window)):
        # different words under one hash: rank whole windows instead
        group = np.unique(codes[at[:, None] + np.arange(window)], axis=0, return_inverse=True)[1].reshape(-1)
        order = np.argsort(group, kind="stable")
        at, group, doc = at[order], group[order], doc[order]
        heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        head = np.repeat(heads, np.diff(np.append(heads, len(at))))
    smallest = np.repeat(np.minimum.reduceat(doc, heads), np.diff(np.append(heads, len(at))))
    gone = np.sort(at[doc > smallest])
    row = owner[gone]
    first = places[row] + (gone - starts[row])
    return _merged(ids[row], hashes[row], first, first + window)


def _resolve(batches: Iterator[pa.RecordBatch], window: int, shared: int) -> Iterator[pa.RecordBatch]:
    """Spans of all buckets of a partition that is sorted by bucket."""
    def rows():
        for batch in batches:
            yield from zip(batch["bucket"].to_pylist(), batch["size"].to_pylist(), batch["data"].to_pylist())

    def spans(held):
        if held:
            yield repeated_spans(held, window, shared)

    def found():
        bucket, held = None, []
        for b, size, data in rows():
            if b < 0:
                yield _unpack(size, data)[0]
                continue
            if b != bucket:
                yield from spans(held)
                bucket, held = b, []
            held.append((size, data))
        yield from spans(held)

    for columns in found():
        for k in range(0, len(columns[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[k:k + 100_000]) for c in columns], ["id", "hash", "first", "end"])


def _one_of(docs: DataFrame, share: int) -> DataFrame:
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)


def frequent_words(docs: DataFrame, total: int) -> list[bytes]:
    """Words that are frequent in a sample of the texts, at most ``SHARED_WORDS`` of at most 40 characters.

    They only shorten what travels: a word that is not among them travels as it is, and results are the same.
    """
    share = max(1, total // SAMPLED_BYTES)
    words = _one_of(docs, share).select(F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).where("word <> '' AND length(word) <= 40")
    counts = words.groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(SHARED_WORDS)
    return [r.word.encode() for r in counts.collect()]


def repeated_passages(docs: DataFrame, window: int = 13) -> DataFrame:
    """``id``, ``hash``, ``first``, ``end``: spans of words in windows that a document with a smaller id has too.

    ``docs`` has ``doc_id`` (bigint), ``text`` and ``text_hash``. Spans of one document may overlap. What the buckets will
    hold is first estimated on one document in ``LOAD_SHARE``; it decides how words travel, never what is found.
    """
    known = docs.where("doc_id IS NOT NULL")
    total = known.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))

    shared = frequent_words(known, total)

    def packed(rows: DataFrame, large: np.ndarray, pieces: int) -> DataFrame:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gatherer = _Gatherer(shared)
            found = (_cut(b, window, buckets, large, pieces, gatherer) for b in batches)
            yield from _in_batches(chain(chain.from_iterable(found), gatherer.flush()))
        return map_arrow(rows, cut, PACKED)

    sizes = (packed(_one_of(known, LOAD_SHARE), np.zeros(0, dtype=np.int64), 1).where("bucket >= 0").groupBy("bucket")
             .agg((F.sum("size") * LOAD_SHARE).alias("size")).where(F.col("size") > SPLIT_BYTES).collect())
    # every window of a large bucket travels by itself: at most `window` times the words
    pieces = max(1, -(-sum(r["size"] for r in sizes) * window // (4 * BUCKET_BYTES)))
    met = packed(known, np.array(sorted(r.bucket for r in sizes), dtype=np.int64), pieces)
    met = met.repartition("bucket").sortWithinPartitions("bucket")
    return stored(map_arrow(met, lambda batches: _resolve(batches, window, len(shared)),
                            "id bigint, hash bigint, first int, end int"), "repeated-spans")


def _without(text: bytes, first: list[int], end: list[int]) -> tuple[int, int, bytes]:
    words = text.split()
    if not first:
        return len(words), 0, b" ".join(words)
    kept = np.ones(len(words), dtype=bool)
    for a, b in zip(first, end):
        kept[a:b] = False
    left = [words[k] for k in np.flatnonzero(kept).tolist()]
    return len(words), len(words) - len(left), b" ".join(left)


def drop_repeated_passages(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text",
                           texts: bool = True) -> DataFrame:
    """Every document without the words in windows that a document with a smaller id has too.

    Columns: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, with ``texts``, ``kept_text``: the words that
    stay, joined by single spaces. Words are what stands between ASCII white space, unchanged; a window is ``window`` of
    them in a row. Windows are judged on the input, not on what is left of it.

    Neighbouring windows whose least hash of three words in a row is the same travel together as one string of words to
    the bucket of that hash, so equal windows meet there; a bucket sorts its windows and compares equal hashes word by
    word. Strings are combined per task, which settles copies on the spot. Windows of buckets above ``SPLIT_BYTES`` travel
    one by one, by a hash of the whole window. The spans found are joined to the texts by id and text hash.

    NULL text counts as empty. Documents without id keep all words and take none from others; rows that share an id are
    judged one by one and take none from each other. Texts shorter than a window stay whole. Ids must be integers.
    An empty table gives an empty result.
    """
    rows = docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                       F.coalesce(docs[text_column], F.lit("")).alias("text"))
    # the hash only tells rows of one id apart, which is rare; it would take a fifth of what the buckets get
    several = rows.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    alone = several.where("doc_id IS NOT NULL AND low <> high").isEmpty()
    rows = rows.withColumn("text_hash", F.lit(0).cast("bigint") if alone else F.xxhash64("text"))
    spans = (repeated_passages(rows, window).groupBy("id", "hash")
             .agg(F.collect_list(F.struct("first", "end")).alias("spans"))
             .select("id", "hash", "spans.first", "spans.end"))
    joined = rows.join(spans, (F.col("doc_id") == F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_without(t, a or [], b or []) for t, a, b in zip(
                batch["text"].cast(pa.binary()).to_pylist(), batch["first"].to_pylist(), batch["end"].to_pylist())]
            columns = [batch["doc_id"], pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()),
                       pa.array([hashlib.sha256(d[2]).hexdigest() for d in done], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns, names = columns + [pa.array([d[2] for d in done], pa.binary()).cast(pa.string())], names + ["kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if texts else "")
    return map_arrow(joined.select("doc_id", "text", "first", "end"), finish, schema)
