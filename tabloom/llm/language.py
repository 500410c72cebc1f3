"""Language of texts: averaged embeddings of hashed letter groups under a linear softmax, with calibrated rejection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tabloom.llm.common import map_arrow

BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)         # letters per group; the edge of a word counts as one
UNKNOWN = "und"
UNSEEN = 0.001               # share of the letter groups of a text that may be new, spread over all buckets
LEAST_APART = 50             # kept-apart texts below which they are too few to say how unfamiliar a text may be
SAMPLE_ROWS = 2000           # expected number of labelled texts that the model is fitted on; at most twice as many


@cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def groups(text: str) -> np.ndarray:
    """Buckets of all letter groups of a whole text, repeats included; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint16)
    x = np.concatenate([[0], np.where(letter, points, 0), [0]]).astype(np.uint32)
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]      # a run of other characters is one edge
    found = []
    for size in SIZES:
        n = len(x) - size + 1
        if n <= 0:
            continue
        h, valid = np.full(n, size, dtype=np.uint32), np.ones(n, dtype=bool)
        for k in range(size):
            part = x[k:k + n]
            h = h * np.uint32(16777619) ^ part
            if size == 1 or 0 < k < size - 1:
                valid &= part != 0
        h = h[valid] * np.uint32(2654435761)
        found.append((h >> np.uint32(16)).astype(np.uint16))
    return np.concatenate(found)


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray          # score of each bucket for each label: embedding times weights
    bias: np.ndarray
    temperature: float
    threshold: float           # texts whose best probability is lower are rejected
    familiar: np.ndarray | None = None       # for each label, log of the share of each bucket in its texts
    least: float = -np.inf     # texts whose mean under their label is lower are rejected

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Label, its calibrated probability, and whether the text is rejected; ``und`` and 0 without letters."""
        found = groups(text) if text else np.zeros(0, dtype=np.uint16)
        if not len(found):
            return UNKNOWN, 0.0, True
        p = _softmax((self.table[found].mean(axis=0, dtype=np.float64) + self.bias) / self.temperature)
        best = int(p.argmax())
        strange = self.familiar is not None and self.familiar[best][found].mean(dtype=np.float64) < self.least
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold or strange)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _sample(labelled: DataFrame, rows: int) -> pa.Table:
    """Letter groups of about ``rows`` labelled texts, as many of each label as there are up to an even share."""
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        raise ValueError("no labelled text to learn from")
    share = rows / len(counts)
    chance = F.create_map(*[F.lit(v) for label, n in counts.items() for v in (label, min(1.0, share / n))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 20)) / float(1 << 20)
    chosen = labelled.where(draw < chance[F.col("label")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(groups(t), return_counts=True) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["label"], pa.array([b.tobytes() for b, _ in found], pa.binary()),
                 pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())],
                ["key", "label", "buckets", "counts"])

    return map_arrow(chosen, count, "key string, label string, buckets binary, counts binary").limit(2 * rows).toArrow()


def _counts(sample: pa.Table) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Buckets, their shares of the text and the label, in an order that doesn't depend on the cluster."""
    found = []
    for batch in sample.to_batches():
        for key, label, buckets, counts in zip(*(batch[c] for c in ("key", "label", "buckets", "counts"))):
            b, n = np.frombuffer(buckets.as_py(), dtype=np.uint16), np.frombuffer(counts.as_py(), dtype=np.uint32)
            if len(b):
                found.append((key.as_py() or "", label.as_py(), b, (n / n.sum()).astype(np.float32)))
    found.sort(key=lambda f: (f[0], f[1], f[2].tobytes()))
    return [(b, share, label) for _, label, b, share in found]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, dimensions: int = 16, epochs: int = 6, rate: float = 2.0,
        seed: int = 7) -> LanguageModel:
    """Model of the labels of ``labelled`` (columns ``key``, ``text``, ``label``).

    Learns from a bounded sample: about ``sample_rows`` texts spread evenly over the labels and chosen by a hash of the
    key, of which only bucket counts reach the driver. Stochastic gradient descent in numpy, one text a step. A fifth
    of the sample is kept apart to set the temperature of the probabilities (least log loss) and two thresholds of
    rejection. Probabilities are high for unknown languages too, so the first only takes texts near even odds: half the
    lowest probability that a correctly labelled text of it gets, at most a tenth above even. The second is on
    familiarity, the mean log share that a text's letter groups have in the learnt texts of its label: as far below the
    lowest of the correctly labelled texts kept apart as that is below their median. Where fewer than 50 are kept apart,
    nothing is rejected as unfamiliar. NULL labels and texts without letters teach nothing.
    """
    rows = labelled.where("label IS NOT NULL AND text IS NOT NULL").select(
        F.col("key").cast("string").alias("key"), "text", F.col("label").cast("string").alias("label"))
    texts = _counts(_sample(rows, sample_rows))
    if not texts:
        raise ValueError("no labelled text to learn from")
    labels = sorted({t[2] for t in texts})
    random = np.random.default_rng(seed)
    weigh = [(b, share, labels.index(name)) for b, share, name in texts]
    order = random.permutation(len(weigh))
    apart, learn = order[:len(order) // 5], order[len(order) // 5:]
    embedding = random.uniform(-1, 1, (BUCKETS, dimensions)).astype(np.float32) / dimensions
    weights, bias = np.zeros((dimensions, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    steps, step = epochs * len(learn), 0
    for _ in range(epochs):
        for k in random.permutation(learn):
            buckets, share, label = weigh[k]
            mean = share @ embedding[buckets]
            error = _softmax(mean @ weights + bias).astype(np.float32)
            error[label] -= 1
            now = np.float32(rate * (1 - step / steps))
            back = weights @ error
            weights -= now * np.outer(mean, error)
            bias -= now * np.float32(0.1) * error
            embedding[buckets] -= now * np.outer(share, back)
            step += 1
    table = embedding @ weights
    scores = np.array([share @ table[b] + bias for b, share, _ in (weigh[k] for k in apart)], dtype=np.float64).reshape(-1, len(labels))
    truth = np.array([weigh[k][2] for k in apart], dtype=int)
    temperature, threshold = 1.0, 0.0
    if len(truth):
        heats = np.geomspace(0.05, 20, 121)
        losses = []
        for heat in heats:
            z = scores / heat
            z -= z.max(axis=1, keepdims=True)
            losses.append(float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(truth)), truth]).mean()))
        temperature = float(heats[int(np.argmin(losses))])
        p = np.array([_softmax(s / temperature) for s in scores])
        right = p.max(axis=1)[p.argmax(axis=1) == truth]
        threshold = min(1.1 / len(labels), float(right.min()) / 2) if len(right) and len(labels) > 1 else 0.0
    shares = np.zeros((len(labels), BUCKETS))
    for buckets, share, label in (weigh[k] for k in learn):
        shares[label, buckets] += share
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-9)
    familiar, least = np.log((1 - UNSEEN) * shares + UNSEEN / BUCKETS).astype(np.float32), -np.inf
    if len(truth) >= LEAST_APART:
        means = [float(share @ familiar[t][b]) for (b, share, _), t, s in zip((weigh[k] for k in apart), truth, scores)
                 if s.argmax() == t]
        if means:
            least = 2 * min(means) - float(np.median(means))
    return LanguageModel(labels, table, bias, temperature, threshold, familiar, least)


def predict(docs: DataFrame, model: LanguageModel, text_column: str = "text",
            new: Sequence[str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """``docs`` with all its columns and the three ``new`` ones; earlier columns of these names go.

    The model (a row of one number per label for each of the 65,536 buckets) is broadcast; its size depends on the
    number of labels only. Texts are read whole. NULL text and texts without letters are ``und`` with score 0 and
    rejected.
    """
    rows = docs.select(*[docs[c] for c in docs.columns if c.lower() not in new])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.predict(t.as_py()) for t in batch[text_column]]
            names, scores, rejected = zip(*found) if found else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

    added = map(StructField, new, (StringType(), DoubleType(), BooleanType()))
    schema = StructType([*rows.schema.fields, *added])
    return map_arrow(rows, label, schema)


def held_out(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``: the CRC-32 of the id as text leaves remainder 0 by 5; never for a NULL id."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)))


def label_documents(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Language of every document, learnt from the labelled documents that aren't held out.

    Columns: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``rejected``. Neither ``lang`` nor ``doc_id`` has a
    part in a prediction. A NULL id isn't held out; repeated rows are all returned; where nothing is labelled, as in an
    empty table, every text is ``und``.
    """
    marked = held_out(docs.select("doc_id", "text", "lang"))
    known = marked.where("NOT held_out").select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label"))
    try:
        model = fit(known, sample_rows)
    except ValueError:
        return marked.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
                             F.lit(True).alias("rejected"))
    return predict(marked.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def drop_unidentified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with all its columns, without texts that have no letters or that the model rejects.

    Learns from the documents with ``lang``; where there are none, only texts without letters go.
    """
    try:
        model = fit(docs.select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("label")), sample_rows)
    except ValueError:
        model = LanguageModel([UNKNOWN], np.zeros((BUCKETS, 1), np.float32), np.zeros(1, np.float32), 1.0, 0.0)
    new = ("__language", "__score", "__rejected")
    return predict(docs, model, new=new).where("NOT __rejected").drop(*new)
