"""I-Match fingerprints over several randomised lexicons.

The lexicon has the terms whose document frequency lies within a band; a term below the
band's lower share is in few documents, so no more terms can be in it than the mean number
of distinct terms in a text divided by that share, whatever the number of documents.  It is
therefore broadcast.  Each of SUBSETS random subsets of the lexicon keeps a term with one of
several rates; a text's distinct terms in a subset are sorted and hashed.  Dense subsets
suit short texts and sparse ones long texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches
from .text import U, batch_words, mix

#: The band of document frequency as shares of all documents; log(1 / share) is the idf.
LEAST_SHARE, MOST_SHARE = 0.0005, 0.2
#: A term of a small corpus must be in so many documents at least.
LEAST_DOCS = 2
#: Random subsets for each rate; rates are powers of RATE, the last suits texts of about 800,000 lexicon terms.
SUBSETS, RATES, RATE = 16, 13, 3


def distinct_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) sorted, each once a text."""
    h, doc, _ = batch_words(texts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def lexicon(docs: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> np.ndarray:
    """Sorted hashes of the terms within the band; frequencies are counted over all documents."""
    small_batches(docs.sparkSession)

    def count(batches):
        held, n = [], 0

        def emit(parts):
            term, many = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(many, pa.int64())], names=["term", "n"])

        for batch in batches:
            _, term = distinct_terms(batch.column(0))
            held.append(term)
            n += len(term)
            if n > 4_000_000:
                yield emit(held)
                held, n = [], 0
        if n:
            yield emit(held)

    total = docs.count()
    low, high = max(LEAST_DOCS, least * total), max(LEAST_DOCS, most * total)
    found = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where((F.col("n") >= low) & (F.col("n") <= high))
    return np.sort(found.select("term").toArrow()["term"].to_numpy().view(np.uint64))


class Fingerprints:
    """Hashes of a text's terms in each subset; 0 where a subset has none of them."""

    def __init__(self, terms: np.ndarray) -> None:
        self.terms = terms
        self.rows = np.arange(SUBSETS * RATES)

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, number of terms) for every text; one without lexicon terms uses all of its terms."""
        n = len(texts)
        doc, term = distinct_terms(texts)
        known = np.zeros(len(term), dtype=bool)
        if len(self.terms):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            known = self.terms[at] == term
        known |= (np.bincount(doc, known, minlength=n) == 0)[doc]
        doc, term = doc[known], term[known]
        out = np.zeros((n, SUBSETS * RATES), dtype=np.uint16)
        for k in range(SUBSETS):
            chance = mix(term ^ mix(np.array([k + 1], dtype=U)))
            d, v = doc, mix(chance)
            for r in range(RATES):
                inside = chance < U((1 << 64) // RATE**r - (r == 0))
                chance, d, v = chance[inside], d[inside], v[inside]  # each within the last, still sorted by text, then term
                if not len(d):
                    break
                first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                place = np.arange(len(d)) - np.repeat(first, np.diff(np.append(first, len(d))))
                total = np.add.reduceat(mix(v + place.astype(U)), first)
                out[d[first], k * RATES + r] = ((mix(total) >> U(48)) | U(1)).astype(np.uint16)
        return out, np.bincount(doc, minlength=n)


def likeness(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Shares of equal hashes, among those subsets that hold about two of a text's terms; 1 where all hashes are equal."""
    n = len(a)
    size = np.maximum(1, np.maximum(na, nb))
    rate = np.clip(np.round(np.log(size / 1.5) / np.log(RATE)), 0, RATES - 1).astype(int)
    at = np.arange(SUBSETS)[None] * RATES + rate[:, None]
    x, y = np.take_along_axis(a, at, 1), np.take_along_axis(b, at, 1)
    some = (x != 0) | (y != 0)
    same = ((x == y) & some).sum(axis=1) / np.maximum(1, some.sum(axis=1))
    return np.where((a == b).all(axis=1), 1.0, np.where(some.any(axis=1), same, 0.0)) if n else np.zeros(0)


def text_of(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def fingerprint_texts(docs: DataFrame, terms: np.ndarray, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and the fingerprint of every text; null and empty texts have all zeros."""
    small_batches(docs.sparkSession)
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    schema = docs.select(*keep, F.lit("").alias("fingerprint")).schema

    def run(batches):
        prints = Fingerprints(terms)
        for batch in batches:
            rows, _ = prints.of(batch.column(at))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([text_of(r) for r in rows], pa.string())], names=[*keep, "fingerprint"])

    return docs.select(*columns).mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of text replaced by the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_edits(docs: DataFrame, terms: np.ndarray, slices: int) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to it and to the next text.

    Documents are dealt to ``slices`` ranges of doc_id; the first of each range, one row a
    range, goes to the range before too, where it only follows (the very first goes to the
    last).  Rows of equal ids follow each other by text.  Rows of null ids follow
    each other before all others.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = np.array(sorted(set(base.stat.approxQuantile("doc_id", [i / slices for i in range(1, slices)], 0.25 / slices))) if slices > 1 else [], dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "right").astype(np.int32))

    part = part_of(F.coalesce("doc_id", F.lit(-(2**63))))  # null ids go to the first range

    firsts = base.select(part.alias("part"), "doc_id").groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id"))["doc_id"].alias("first")).orderBy("part").collect()
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # one row of each range's first id, the one of least text, is what follows the range before
    before = spark.createDataFrame([(firsts[i]["first"], firsts[i - 1]["part"]) for i in range(len(firsts))], "first long, to int")
    heads = base.join(F.broadcast(before), base.doc_id.eqNullSafe(before['first'])).groupBy("doc_id", "to").agg(F.min("text").alias("text"))
    rows = base.select(part.alias("part"), F.lit(False).alias("follows"), "doc_id", "text").union(heads.select(F.col("to").alias("part"), F.lit(True), "doc_id", "text"))
    dealt = rows.repartition(len(firsts), "part").sortWithinPartitions("part", "follows", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches):
        prints = Fingerprints(terms)
        tail = None  # the row before, still without its next: a batch of one row
        for batch in batches:
            both = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            if both.num_rows > 1:
                yield compared(both, prints)
            tail = both.slice(both.num_rows - 1).to_batches()[0]

    def compared(rows, prints):
        here, following = rows.slice(0, rows.num_rows - 1), rows.slice(1)
        texts = rows["text"].to_pylist()
        changed = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        own, n_own = prints.of(rows["text"].combine_chunks() if rows["text"].num_chunks != 1 else rows["text"].chunk(0))
        new, n_new = prints.of(pa.array(changed, pa.string()))
        a, b, na, nb = own[:-1], own[1:], n_own[:-1], n_own[1:]
        table = pa.table({
            "doc_id": here["doc_id"], "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [text_of(r) for r in a], "edited_fingerprint": [text_of(r) for r in new],
            "near_edited": likeness(a, new, na, n_new), "near_next": likeness(a, b, na, nb),
        })
        # a row that only follows has no row of its own, whatever comes behind it
        kept = table.filter(pc.invert(here["follows"])).combine_chunks()
        return kept.to_batches()[0] if kept.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
