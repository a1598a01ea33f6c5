"""Quality by a sparse ensemble of rules over statistics of a text.

Trees are grown on the statistics of a bounded labelled sample; every path from a root to a
node becomes a conjunctive rule, a lasso logistic regression weighs the rules, and those
whose weight isn't zero are compiled into one Spark column expression.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import training_texts
from .store import small_batches
from .text import U, pieces, raw, words

#: Labelled documents learnt from, at most.
TRAIN_ROWS = 12_000
TREES = 40
DEPTH = 3
BINS = 32
LEAST = 40
PENALTY = 0.01
#: The chosen rules are weighed again with the penalty divided by this (a relaxed lasso).
RELAX = 20

#: Classes of bytes that are counted, as shares of all bytes.
CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (32,), "newline": (10,),
    "stop": (46, 33, 63), "comma": (44,), "bang": (33,), "mark": (35, 36, 37, 38, 42, 43, 64, 94, 126), "bar": (124,),
    "bracket": (40, 41, 60, 62, 91, 93, 123, 125), "quote": (34, 39), "colon": (58, 59), "slash": (47, 92), "high": range(128, 256),
}
NAMES = ["n_bytes", "n_words", "word_length", "longest", "distinct", "repeated", "pairs", "short", "n_lines", "line_repeats", "line_length", "line_stop", "capitals", *(f"share_{c}" for c in CLASSES)]


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of NAMES for every text; a null text counts as empty, an empty one has zeros."""
    body, at = raw(texts)
    n = len(at) - 1
    size = np.diff(at)
    found = {k: np.zeros(n) for k in NAMES}
    found["n_bytes"] = size.astype(float)
    some = np.maximum(size, 1)
    parts = list(pieces(body, at))
    for name, bytes_ in CLASSES.items():
        inside = np.zeros(256, dtype=bool)
        inside[list(bytes_)] = True
        for b, a, first in parts:
            total = np.concatenate([[0], np.cumsum(inside[b], dtype=np.int64)])
            found[f"share_{name}"][first : first + len(a) - 1] += total[a[1:]] - total[a[:-1]]
        found[f"share_{name}"] /= some
    hashes = []
    for b, a, first in parts:
        h, doc, length = words(b, a)
        hashes.append((h, doc + first, length))
        edge = np.zeros(len(b) + 1, dtype=bool)
        edge[a] = True
        upper = (b >= 65) & (b <= 90)
        opens = upper & np.concatenate([[True], (b[:-1] == 32) | (b[:-1] == 10)])
        found["capitals"] += np.bincount(np.searchsorted(a, np.flatnonzero(opens), "right") - 1 + first, minlength=n)
    h, doc, length = (np.concatenate(x) for x in zip(*hashes, strict=True)) if hashes else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    count = np.bincount(doc, minlength=n)
    least = np.maximum(count, 1)
    found["n_words"] = count.astype(float)
    found["word_length"] = np.bincount(doc, length, minlength=n) / least
    found["short"] = np.bincount(doc, length <= 3, minlength=n) / least
    found["capitals"] /= least
    np.maximum.at(found["longest"], doc, length.astype(float))

    def repeats(keys, of):
        order = np.lexsort((keys, of))
        new = np.ones(len(keys), dtype=bool)
        new[1:] = (keys[order][1:] != keys[order][:-1]) | (of[order][1:] != of[order][:-1])
        runs = np.flatnonzero(new)
        return np.bincount(of[order][runs], minlength=n), of[order][runs], np.diff(np.append(runs, len(keys)))

    kinds, of, many = repeats(h, doc)
    found["distinct"] = kinds / least
    np.maximum.at(found["repeated"], of, many.astype(float))
    found["repeated"] /= least
    if len(h) > 1:
        same = doc[1:] == doc[:-1]
        kinds, _, _ = repeats((h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])[same], doc[1:][same])
        found["pairs"] = kinds / np.maximum(count - 1, 1)
    newline = np.ones(256, dtype=bool)
    newline[10] = False
    lines = []
    for b, a, first in pieces(body, at, newline):  # cut at line ends only
        lh, ld, ll = words(b, a, newline)
        lines.append((lh, ld + first, ll))
        ends = np.flatnonzero(np.append(b[1:] == 10, True) | np.isin(np.arange(1, len(b) + 1), a[1:]))
        stops = ends[np.isin(b[ends], CLASSES["stop"])]
        found["line_stop"] += np.bincount(np.searchsorted(a, stops, "right") - 1 + first, minlength=n)
    if lines:
        lh, ld, ll = (np.concatenate(x) for x in zip(*lines, strict=True))
        many = np.bincount(ld, minlength=n)
        kinds, _, _ = repeats(lh, ld)
        found["n_lines"] = many.astype(float)
        found["line_repeats"] = 1 - kinds / np.maximum(many, 1)
        found["line_repeats"][many == 0] = 0
        found["line_length"] = np.bincount(ld, ll, minlength=n) / np.maximum(many, 1)
        found["line_stop"] /= np.maximum(many, 1)
    return np.column_stack([found[k] for k in NAMES])


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of docs and a struct ``stats`` of NAMES.

    Null and empty texts have zeros; every row of an equal id or text has its own row; a very long text is
    worked on in pieces, with the same result; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    stats = T.StructType([T.StructField(k, T.DoubleType()) for k in NAMES])
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("stats", stats)])

    def run(batches):
        for batch in batches:
            x = statistics(batch.column(at))
            found = pa.StructArray.from_arrays([pa.array(x[:, i]) for i in range(len(NAMES))], names=NAMES)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), found], names=[*keep, "stats"])

    return docs.select(*columns).mapInArrow(run, schema)


def _grow(x, g, w, bins, cuts, rows, depth, path, rules, choose) -> None:
    """Split rows where the weighted residual's squared sums gain most; each node's path is a rule."""
    if path:
        rules.append(tuple(path))
    if depth == 0 or len(rows) < 2 * LEAST:
        return
    best = (1e-9, None)
    for j in choose.choice(x.shape[1], max(3, x.shape[1] // 3), replace=False):
        b = bins[rows, j]
        sg, sw, sn = (np.cumsum(np.bincount(b, v, minlength=BINS + 1)) for v in (g[rows], w[rows], np.ones(len(rows))))
        ok = (sn >= LEAST) & (sn[-1] - sn >= LEAST)
        gain = sg**2 / np.maximum(sw, 1e-9) + (sg[-1] - sg) ** 2 / np.maximum(sw[-1] - sw, 1e-9) - sg[-1] ** 2 / sw[-1]
        gain[~ok] = 0
        k = int(gain[: len(cuts[j])].argmax()) if len(cuts[j]) else 0
        if len(cuts[j]) and gain[k] > best[0]:
            best = (gain[k], (j, k))
    if best[1] is None:
        return
    j, k = best[1]
    left = bins[rows, j] <= k
    _grow(x, g, w, bins, cuts, rows[left], depth - 1, [*path, (int(j), "<=", float(cuts[j][k]))], rules, choose)
    _grow(x, g, w, bins, cuts, rows[~left], depth - 1, [*path, (int(j), ">", float(cuts[j][k]))], rules, choose)


def holds(rule: tuple, x: np.ndarray) -> np.ndarray:
    return reduce(and_, [(x[:, j] <= v) if op == "<=" else (x[:, j] > v) for j, op, v in rule])


def fit(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple], np.ndarray, float]:
    """(rules, weights, intercept); one class alone gives its smoothed rate and no rules."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    if len(y) < 2 * LEAST or y.min() == y.max():
        return [], np.zeros(0), float(np.log(rate / (1 - rate)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    choose = np.random.default_rng(0)
    rules: list[tuple] = []
    score = np.full(len(y), np.log(rate / (1 - rate)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(choose.random(len(y)) < 0.6)
        grown: list[tuple] = []
        _grow(x, y - p, p * (1 - p) + 1e-6, bins, cuts, rows, DEPTH, [], grown, choose)
        for rule in grown:  # leaves step the score on, so that later trees look elsewhere
            inside = holds(rule, x)
            if inside.any():
                score[inside] += 0.1 * np.clip((y - p)[inside].sum() / (p * (1 - p) + 1e-6)[inside].sum(), -4, 4)
        rules += grown
    rules = list(dict.fromkeys(rules))
    if not rules:
        return [], np.zeros(0), float(np.log(rate / (1 - rate)))
    m = np.column_stack([holds(r, x) for r in rules]).astype(np.float32)
    same: dict = {}  # rules that hold for the same rows are one
    for i, column in enumerate(np.packbits(m.astype(bool), axis=0).T):
        same.setdefault(column.tobytes(), i)
    first = list(same.values())
    m, rules = m[:, first], [rules[i] for i in first]
    mean = m.mean(axis=0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 0.01))  # a rule's reach counts as in a standardised lasso
    m /= scale
    w, b = _lasso(m, y, rate, PENALTY)
    kept = np.flatnonzero(w)
    if not len(kept):
        return [], np.zeros(0), b
    w, b = _lasso(np.ascontiguousarray(m[:, kept]), y, rate, PENALTY / RELAX)  # the chosen rules' weights, shrunk less
    return [rules[i] for i in kept], (w / scale[kept]).astype(float), b


def _lasso(m: np.ndarray, y: np.ndarray, rate: float, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a lasso logistic regression, by accelerated proximal steps."""
    n = m.shape[1]
    w, at, b, last = np.zeros(n, np.float32), np.zeros(n, np.float32), float(np.log(rate / (1 - rate))), 1.0
    step = 4 / max(1e-9, _norm(m) ** 2 / len(y))
    for _ in range(300):
        p = 1 / (1 + np.exp(-(m @ at + b)))
        new = at - step * (m.T @ (p - y).astype(np.float32)) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        b -= float((p - y).mean())
        nxt = (1 + np.sqrt(1 + 4 * last**2)) / 2
        at, w, last = new + (last - 1) / nxt * (new - w), new, nxt
    return w, b


def _norm(m: np.ndarray) -> float:
    v = np.ones(m.shape[1], np.float32)
    for _ in range(20):
        v = m.T @ (m @ v)
        v /= np.linalg.norm(v) + 1e-12
    return float(np.linalg.norm(m @ v))


def compiled(model: tuple[list[tuple], np.ndarray, float], stats: str = "stats") -> Column:
    """The ensemble as a Spark column: the probability of label 1."""
    rules, weights, intercept = model

    def one(rule):
        return reduce(and_, [(F.col(f"{stats}.{NAMES[j]}") <= v) if op == "<=" else (F.col(f"{stats}.{NAMES[j]}") > v) for j, op, v in rule])

    def total(terms):  # a balanced tree: hundreds of nested sums would be too deep a plan
        return terms[0] if len(terms) == 1 else total(terms[: len(terms) // 2]) + total(terms[len(terms) // 2 :])

    terms = [F.when(one(r), F.lit(float(w))).otherwise(F.lit(0.0)) for r, w in zip(rules, weights, strict=True)]
    return 1 / (1 + F.exp(-total([F.lit(intercept), *terms])))


def learn_from(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[tuple], np.ndarray, float]:
    """Fit in one task on the statistics of at most ``most`` labelled documents; only the rules come to the driver.

    Null and empty texts are learnt from as any other, a very long text is one row.  Of rows of equal ids the
    one of the least statistics counts, and a document labelled twice is good if any label says so.
    Without labelled documents, or in empty tables, every score is one half.  Other columns of docs and labels are ignored.
    """
    every = with_statistics(training_texts(docs, labels, "quality", most), ["doc_id", "y"])
    sample = every.groupBy("doc_id", "y").agg(F.min("stats").alias("stats")).select("doc_id", "y", "stats.*")

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            x = np.column_stack([table[k].to_numpy() for k in NAMES])
            ids, y = table["doc_id"].to_numpy(), table["y"].to_numpy().astype(float)
            order = np.lexsort((*x.T[::-1], ids))  # whatever order the rows came in
            rules, weights, intercept = fit(x[order], y[order])
            yield pa.RecordBatch.from_pydict({"model": [json.dumps([rules, weights.tolist(), intercept])]})

    found = [json.loads(r["model"]) for r in sample.repartition(1).mapInArrow(run, "model string").collect()]
    if not found:
        return [], np.zeros(0), 0.0
    rules, weights, intercept = found[0]
    return [tuple(tuple(c) for c in r) for r in rules], np.array(weights), intercept
