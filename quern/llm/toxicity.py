"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased (A-Z) runs of letters and digits.  Features are present or absent:
words, pairs of neighbours, and pairs with one word between.  Each coordinate has its own
learning rate, and the L1 term leaves most weights at exactly zero; the few others,
at most ``SPACE`` of them, go to the executors with the scoring task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import training_texts
from .store import small_batches
from .text import U, batch_words, mix

#: Hashed features; the last index is the intercept.
SPACE = 1 << 20
#: Labelled documents learnt from, at most.
TRAIN_ROWS = 12_000
#: Documents of the sample that a feature must be in to get a weight.
LEAST_DOCS = 5
EPOCHS = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.0

LETTERS = np.zeros(256, dtype=bool)
LETTERS[48:58] = LETTERS[97:123] = LETTERS[128:] = True


def features(texts: pa.Array, weight_of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, feature) pairs, sorted; only features whose weight_of isn't zero, if given."""
    h, doc, _ = batch_words(texts, LETTERS)
    found = [(doc, h)]
    for gap in (1, 2):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = mix(h[:-gap] * U(0x9E3779B97F4A7C15) + h[gap:] + U(gap))
            found.append((doc[:-gap][same], pair[same]))
    rows = []
    for d, x in found:
        f = (x >> U(44)).astype(np.int64)  # the top 20 bits: SPACE
        if weight_of is not None:
            keep = weight_of[f] != 0
            d, f = d[keep], f[keep]
        rows.append(d * SPACE + f)
    key = np.unique(np.concatenate(rows))
    return key // SPACE, key % SPACE


def train(examples: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, weight) of the non-zero weights; feature SPACE is the intercept. examples: each text's distinct features."""
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    docs = np.zeros(SPACE, dtype=np.int64)
    for f in examples:
        docs[f] += 1
    often = docs >= LEAST_DOCS
    examples = [f[often[f]] for f in examples]
    order = np.random.default_rng(0)

    def weights(i):
        zi = z[i]
        free = i == SPACE  # the intercept isn't shrunk
        return np.where((np.abs(zi) <= L1) & ~free, 0.0, -(zi - np.sign(zi) * L1 * ~free) / ((BETA + np.sqrt(n[i])) / ALPHA + L2 * ~free))

    for _ in range(EPOCHS):
        for k in order.permutation(len(examples)):
            i = np.append(examples[k], SPACE)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weights(np.arange(SPACE + 1))
    kept = np.flatnonzero(w)
    return kept, w[kept]


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt on the executors from a sample of at most ``most`` labelled documents, in one task.

    Null and empty texts are learnt from as texts without features.  Of rows of equal ids the one whose
    packed features are least counts, and a document labelled twice is toxic if any label says so.
    Without labelled documents, or in empty tables, the intercept alone is left, at 0.  Other columns of docs and labels are ignored.
    """
    small_batches(docs.sparkSession)

    def read(batches):
        for batch in batches:
            doc, feature = features(batch.column(1))
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            packed = [feature[i:j].astype(np.int32).tobytes() for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary())], names=["doc_id", "y", "features"])

    def run(batches):
        rows = []
        for b in batches:
            rows += zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
        if rows:
            rows.sort()  # whatever order the rows came in
            kept, w = train([np.frombuffer(f, np.int32) for _, _, f in rows], np.array([y for _, y, _ in rows]))
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(w, pa.float64())], names=["feature", "weight"])

    every = training_texts(docs, labels, "toxic", most).select("doc_id", "text", "y").mapInArrow(read, "doc_id long, y int, features binary")
    sample = every.groupBy("doc_id", "y").agg(F.min("features").alias("features"))
    rows = sample.repartition(1).mapInArrow(run, "feature long, weight double").toArrow()
    return rows["feature"].to_numpy(), rows["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs and a score from 0 to 1, a row for every row of docs.

    Null and empty texts get the intercept's; equal texts get equal scores, whatever their ids; very long
    texts are scored whole; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kept, w = model
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    names = [f.name for f in schema]

    def run(batches):
        dense = np.zeros(SPACE + 1)
        dense[kept] = w
        for batch in batches:
            doc, feature = features(batch.column(at), dense)
            total = np.bincount(doc, dense[feature], minlength=batch.num_rows) + dense[SPACE]
            found = pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), found], names=names)

    return docs.select(*columns).mapInArrow(run, schema)
