"""A Katz backoff model of word pairs, learnt and evaluated over all tokens of a table.

Tokens are a text's words, lower-cased (A-Z), then one end; the context of a text's first
token is the end.  The model's order is two: pairs back off to words, words to one event for
all unknown words.  Counts up to K are discounted by Good-Turing, and the backoff weights make
every context's distribution over the known words and the unknown event sum to 1 exactly.

No table of the model is ever gathered in one place.  Texts are worked on in chunks of about
CHUNK tokens, and what moves between tasks are packed arrays:

1. each chunk asks for its distinct words; tasks that own ranges of words add up the counts
   of all chunks, number the words, store the unigram table, and answer each chunk;
2. each chunk, with its answers, sends every distinct pair and the documents that hold it to
   the pair's owner, chosen by context; contexts that are frequent, a number bounded by the
   number FREQUENT, are spread over as many owners as their counts ask for;
3. owners add up the counts and store the bigram table by owner; counts of counts
   and the sums of frequent contexts, at most FREQUENT rows, come to the driver;
4. owners read their part, find discounts and backoff weights, and evaluate each pair they
   were asked for; the documents' partial sums are added up by chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import column, discard, grouped, small_batches, stored
from .text import U, batch_words, mix

#: Counts up to K are discounted.
K = 5
#: Tokens of a chunk, and of an owner's share, about.
CHUNK = 1_000_000
SHARE = 1_500_000
#: Bytes of text for each owner of words.
WORD_BYTES = 1 << 26
#: Frequent contexts, at most: a context is frequent if it has more than this share of all training tokens.
FREQUENT = 100_000
END = U(0x243F6A8885A308D3)


def pack(x: np.ndarray) -> bytes:
    """The bytes of an array, plane by plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(b: bytes, kind) -> np.ndarray:
    size = int.from_bytes(b[:8], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(b[8:], size, "zstd", asbytes=True), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def discounts(n: np.ndarray) -> np.ndarray:
    """Good-Turing discount ratios of the counts 0..K (0 stands for undiscounted) from the numbers n[r] of events seen r times.

    Where the counts of counts give no ratio between 0 and 1, absolute discounting does.
    """
    d = np.ones(K + 1)
    flat = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] else 0.5
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = ratio if 0 < ratio < 1 else (r - flat) / r
    return d


class Unigrams:
    """What the pairs need of the words: probabilities by count, and those of the base score."""

    def __init__(self, counts: np.ndarray, total: int, distinct: int, mass: int) -> None:
        """counts[r]: words seen r times, up to K + 1; mass: tokens of words seen more than K times."""
        self.total, self.distinct = total, distinct
        d = discounts(counts)
        seen = sum(r * counts[r] * d[r] for r in range(1, K + 1)) + mass
        self.scale = 1.0
        if total and not any(counts[1 : K + 1]):
            self.scale = total / (total + 1)
        self.d = d
        self.unknown = 1 - self.scale * seen / total if total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        """Probabilities of words seen so often; of the unknown event for 0."""
        if not self.total:
            return np.ones(len(count))
        return np.where(count > 0, self.scale * np.where(count <= K, self.d[np.minimum(count, K)], 1.0) * count / self.total, self.unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.total + self.distinct + 1.0))


def backoff(total, above, small, seen, d):
    """(scale of seen pairs, backoff weight) of contexts: total count, tokens of pairs seen over K times, numbers of pairs seen 1..K times, and the seen words' unigram mass."""
    total = np.asarray(total, float)
    kept = above + small @ (d[1:] * np.arange(1, K + 1))
    never = small.sum(axis=1) == 0
    scale = np.where(never, total / (total + 1), 1.0)
    left = 1 - scale * kept / np.maximum(total, 1)
    return scale, np.where(total > 0, left / np.maximum(1 - seen, 1e-300), 1.0)


def _chunks(batches):
    """Arrays of about CHUNK tokens: (key, word hashes, local word numbers of all tokens, tokens of each document, ids, held out, id is null)."""

    def made(parts, number):
        ids, flags, lengths, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        distinct, local = np.unique(tokens, return_inverse=True)
        # the content is part of the key: both passes pair by what was read, not by when
        digest = hashlib.blake2b(ids.tobytes() + lengths.tobytes() + distinct.tobytes(), digest_size=4).digest()
        place = TaskContext.get().partitionId() << 40 | number << 24
        return place | int.from_bytes(digest[:3], "little"), distinct, local.astype(np.uint32), lengths, ids, flags

    parts, size, number = [], 0, 0
    for batch in batches:
        h, doc, _ = batch_words(batch.column(1))
        n = batch.num_rows
        words = np.bincount(doc, minlength=n)
        tokens = np.insert(h, np.cumsum(words), END)
        nulls = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        flags = batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8) | nulls.astype(np.uint8) << 1
        parts.append((batch.column(0).fill_null(0).to_numpy(), flags, (words + 1).astype(np.uint32), tokens))
        size += len(tokens)
        if size >= CHUNK:
            yield made(parts, number)
            parts, size, number = [], 0, number + 1
    if size:
        yield made(parts, number)


def _owner(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h.astype(U) + U(1)) >> U(16)).astype(np.int64) % n


def _by_owner(owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(owner, kind="stable")
    return order, np.searchsorted(owner[order], np.arange(n + 1))


def unigram_table(docs: DataFrame, owners: int) -> DataFrame:
    """(owner, chunk, ids, counts, stats): the answers to each chunk in the order of its words by owner, and each owner's counts of counts."""

    def ask(batches):
        for key, distinct, local, lengths, _, flags in _chunks(batches):
            train = np.repeat(flags & 1 == 0, lengths)
            counts = np.bincount(local[train], minlength=len(distinct)).astype(np.uint32)
            order, cuts = _by_owner(_owner(distinct, owners), owners)
            rows = [(key, o, pack(distinct[order[a:b]]), pack(counts[order[a:b]])) for o, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
            yield pa.RecordBatch.from_pydict(dict(zip(("chunk", "owner", "words", "counts"), ([r[i] for r in rows] for i in range(4)), strict=True)), schema=pa.schema([("chunk", pa.int64()), ("owner", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())]))

    def answer(batches):
        for (owner,), parts in grouped(batches, ["owner"]):
            chunks = column(parts, "chunk").to_pylist()
            words = [unpack(b, U) for b in column(parts, "words").to_pylist()]
            counts = np.concatenate([unpack(b, np.uint32) for b in column(parts, "counts").to_pylist()])
            distinct, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.bincount(at, counts, minlength=len(distinct)).astype(np.int64)  # exact below 2^53
            ids = (np.arange(len(distinct)) * owners + owner)[at]
            ends = np.cumsum([0, *map(len, words)])
            stats = [int((total == r).sum()) for r in range(K + 2)] + [int(total.sum()), int((total > 0).sum()), int(total[total > K].sum())]
            for k, chunk in enumerate(chunks):
                some = slice(ends[k], ends[k + 1])
                yield pa.RecordBatch.from_pydict(
                    {"owner": [owner], "chunk": [chunk], "ids": [pack(ids[some].astype(U))], "counts": [pack(total[at[some]].astype(U))], "stats": [stats if not k else None]},
                    schema=pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary()), ("stats", pa.list_(pa.int64()))]),
                )

    asked = docs.mapInArrow(ask, "chunk long, owner int, words binary, counts binary")
    dealt = asked.repartition(owners, "owner").sortWithinPartitions("owner", "chunk")
    return stored(dealt.mapInArrow(answer, "owner int, chunk long, ids binary, counts binary, stats array<long>"), "unigrams")


def _sums(table: DataFrame, name: str, length: int) -> list[int]:
    """The element-wise sum of an array column of fixed length."""
    row = table.where(F.col(name).isNotNull()).agg(*(F.coalesce(F.sum(F.col(name)[i]), F.lit(0)).alias(f"s{i}") for i in range(length))).first()
    return [row[i] for i in range(length)]


PAIR = "owner int, chunk long, docs binary, contexts binary, runs binary, words binary, counts binary, places binary, held binary, hot binary"
PAIR_NAMES = ["docs", "contexts", "runs", "words", "counts", "places", "held", "hot"]


def _distinct(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs in order, where each is first, and which one each row is."""
    if not len(h) or max(int(h.max()), int(w.max())) < 1 << 32:
        key, first, at = np.unique(h << U(32) | w, return_index=True, return_inverse=True)
        return key >> U(32), key & U(0xFFFFFFFF), first, at
    order = np.lexsort((w, h))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])
    at = np.empty(len(h), dtype=np.int64)
    at[order] = np.cumsum(new) - 1
    first = order[new]
    return h[first], w[first], first, at


def bigram_table(docs: DataFrame, unigrams: DataFrame, words: Unigrams, word_owners: int, owners: int) -> DataFrame:
    """One row an owner: its pairs with counts, who asked for them, and sums; and rows of documents."""
    hot = max(2, words.total // (4 * owners), words.total // FREQUENT + 1)

    def state(batches):
        for key, distinct, local, lengths, ids, flags in _chunks(batches):
            order, _ = _by_owner(_owner(distinct, word_owners), word_owners)
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            yield pa.RecordBatch.from_pydict(
                {"chunk": [key], "part": [-1], "a": [pack(place[local])], "b": [pack(lengths)], "c": [pack(ids.astype(np.int64))], "d": [pack(np.append(flags, place[np.searchsorted(distinct, [END])[0]].reshape(1).view(np.uint8)))]},
                schema=pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())]),
            )

    def pairs(batches):
        for (chunk,), parts in grouped(batches, ["chunk"]):
            part = column(parts, "part").to_pylist()
            a, b = column(parts, "a").to_pylist(), column(parts, "b").to_pylist()
            if part[0] != -1:
                raise RuntimeError("the documents were read differently the second time; store them first")
            token, lengths = unpack(a[0], np.uint32), unpack(b[0], np.uint32)
            ids, extra = unpack(column(parts, "c").to_pylist()[0], np.int64), unpack(column(parts, "d").to_pylist()[0], np.uint8)
            flags, end = extra[:-4], int(extra[-4:].copy().view(np.uint32)[0])
            word_id = np.concatenate([unpack(x, U) for x in a[1:]])
            count = np.concatenate([unpack(x, U) for x in b[1:]]).astype(np.int64)
            if len(word_id) <= int(token.max()):
                raise RuntimeError("the documents were read differently the second time; store them first")
            n = len(lengths)
            doc = np.repeat(np.arange(n, dtype=np.uint32), lengths)
            c = count[token]
            # what a document's row holds besides its score
            base = np.bincount(doc, words.base(c), minlength=n)
            known = np.bincount(doc, c > 0, minlength=n).astype(np.int64)
            home = int(_owner(np.array([chunk], dtype=np.int64).view(U), owners)[0])
            rows = [(home, chunk, b"".join(len(x).to_bytes(8, "little") + x for x in (pack(ids), pack(flags), pack(lengths.astype(np.int64)), pack(known), pack(base))), *[None] * 7)]
            context = np.empty_like(token)
            context[1:] = token[:-1]
            context[np.cumsum(lengths) - lengths] = end
            h, w = word_id[context], word_id[token]
            frequent = count[context] >= hot
            shares = (count[context] // hot + 1).astype(U)
            owner = _owner(np.where(frequent, mix(h) + U(1) + mix(w) % shares, mix(h)), owners)
            order = np.lexsort((token, context, owner))
            o, x, y = owner[order], context[order], token[order]
            new = np.ones(len(o), dtype=bool)
            new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            kinds = np.flatnonzero(new)
            runs = np.diff(np.append(kinds, len(o))).astype(np.uint32)
            cuts = np.searchsorted(o[kinds], np.arange(owners + 1))
            held = pack(flags & 1)
            for k in range(owners):
                s, e = cuts[k], cuts[k + 1]
                if e > s:
                    first, last = kinds[s], kinds[e] if e < len(kinds) else len(o)
                    some = kinds[s:e]
                    rows.append((k, chunk, None, pack(word_id[x[some]]), pack(runs[s:e]), pack(word_id[y[some]]), pack(count[y[some]].astype(U)), pack(doc[order[first:last]]), held, pack(np.unique(h[order[some][frequent[order[some]]]]))))
            yield pa.RecordBatch.from_pydict(
                dict(zip(("owner", "chunk", *PAIR_NAMES), ([r[i] for r in rows] for i in range(10)), strict=True)),
                schema=pa.schema([("owner", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in PAIR_NAMES)]),
            )

    def count(batches):
        for (owner,), parts in grouped(batches, ["owner"]):
            chunks = column(parts, "chunk").to_numpy()
            cols = {c: column(parts, c).to_pylist() for c in PAIR_NAMES}
            asked = [i for i, x in enumerate(cols["words"]) if x is not None]
            given = [i for i, x in enumerate(cols["docs"]) if x is not None]
            for i in given:
                yield _row(owner, chunks=[int(chunks[i])], docs=cols["docs"][i])
            if not asked:
                continue
            get = lambda c, kind: [unpack(cols[c][i], kind) for i in asked]
            h, w, seen = (np.concatenate(get(c, U)) for c in ("contexts", "words", "counts"))
            runs = np.concatenate(get("runs", np.uint32))
            places = get("places", np.uint32)
            held = get("held", np.uint8)
            learnt = np.concatenate([f[p] == 0 for f, p in zip(held, places, strict=True)])
            of_chunk = np.repeat(np.arange(len(asked), dtype=np.uint32), [len(p) for p in places])
            places = np.concatenate(places)
            of_asked = np.repeat(np.arange(len(runs)), runs)
            train = np.bincount(of_asked, learnt, minlength=len(runs)).astype(np.int64)
            d_h, d_w, first, at = _distinct(h, w)
            total = np.bincount(at, train, minlength=len(d_h)).astype(np.int64)
            # occurrences by pair
            kind = at[of_asked]
            order = np.argsort(kind, kind="stable")
            stats = [int((total == r).sum()) for r in range(K + 2)]
            yield _row(
                owner, chunks=[int(chunks[i]) for i in asked], contexts=pack(np.diff(d_h, prepend=U(0))), words=pack(d_w), counts=pack(total.astype(U)),
                seen=pack(seen[first]), runs=pack(np.bincount(kind, minlength=len(d_h)).astype(U)), of=pack(of_chunk[order].astype(np.uint16) if len(asked) < 65536 else of_chunk[order]), places=pack(places[order]), hot=pack(np.unique(np.concatenate(get("hot", U)))), stats=stats,
            )

    state_rows = docs.mapInArrow(state, "chunk long, part int, a binary, b binary, c binary, d binary")
    none = F.lit(None).cast("binary")
    answers = unigrams.select("chunk", F.col("owner").alias("part"), F.col("ids").alias("a"), F.col("counts").alias("b"), none.alias("c"), none.alias("d"))
    met = state_rows.union(answers).repartition(owners, "chunk").sortWithinPartitions("chunk", "part")
    sent = met.mapInArrow(pairs, PAIR).repartition(owners, "owner").sortWithinPartitions("owner", "chunk")
    return stored(sent.mapInArrow(count, TABLE), "bigrams")


TABLE = "owner int, chunks array<long>, docs binary, contexts binary, words binary, counts binary, seen binary, runs binary, of binary, places binary, hot binary, stats array<long>"


def _row(owner: int, **columns) -> pa.RecordBatch:
    kinds = {"chunks": pa.list_(pa.int64()), "stats": pa.list_(pa.int64())}
    names = [c.strip().split()[0] for c in TABLE.split(",")]
    schema = pa.schema([("owner", pa.int32()), *((c, kinds.get(c, pa.binary())) for c in names[1:])])
    return pa.RecordBatch.from_pydict({"owner": [owner]} | {c: [columns.get(c)] for c in names[1:]}, schema=schema)


def _contexts(row: dict, words: Unigrams):
    """(contexts, number of each pair's context, pairs' counts, their words' counts, total, above, small, seen mass) of an owner's row."""
    h = np.cumsum(unpack(row["contexts"], U), dtype=np.int64)
    count, seen = unpack(row["counts"], U).astype(np.int64), unpack(row["seen"], U).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    n = len(first)
    total = np.bincount(of, count, minlength=n)
    above = np.bincount(of, np.where(count > K, count, 0), minlength=n)
    small = np.column_stack([np.bincount(of, count == r, minlength=n) for r in range(1, K + 1)])
    mass = np.bincount(of, np.where(count > 0, words.p(seen), 0.0), minlength=n)
    return h[first], of, count, seen, total, above, small, mass


def score(docs: DataFrame, held_mod: int = 7, held_remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model is learnt from the texts whose crc32(doc_id as text) modulo held_mod isn't
    held_remainder; a null id is learnt from.  A null or empty text is one end token.
    Every row counts, those of equal ids or texts too, and has its own row; a very long text is
    scored whole; other columns of docs are ignored; an empty table gives no rows.
    docs must read the same rows in the same order twice, as a table of files does.
    With nothing to learn from all tokens are the unknown event, of probability 1.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_mod == held_remainder, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    word_owners = max(width, size // WORD_BYTES + 1)
    unigrams = unigram_table(rows, word_owners)
    *counts, total, distinct, mass = _sums(unigrams, "stats", K + 5)
    words = Unigrams(np.array(counts, float), total, distinct, mass)
    owners = max(width, total // SHARE + 1)
    table = bigram_table(rows, unigrams, words, word_owners, owners)
    discard(unigrams)
    d = discounts(np.array(_sums(table, "stats", K + 2), float))

    def frequent(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["contexts"] is None:
                    continue
                h, _, _, _, n, above, small, mass = _contexts(row, words)
                some = np.flatnonzero(np.isin(h, unpack(row["hot"], U).astype(np.int64)))
                yield pa.RecordBatch.from_pydict({"h": h[some], "n": n[some].astype(np.int64), "above": above[some].astype(np.int64), "mass": mass[some], **{f"s{r}": small[some, r].astype(np.int64) for r in range(K)}})

    sums = table.select("contexts", "counts", "seen", "hot").mapInArrow(frequent, "h long, n long, above long, mass double, " + ", ".join(f"s{r} long" for r in range(K)))
    sums = sums.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n", "above", "mass", *(f"s{r}" for r in range(K))))).toPandas().sort_values("h")
    hot_h = sums["h"].to_numpy()
    hot_small = sums[[f"s{r}" for r in range(K)]].to_numpy(float)
    hot_total = sums["n"].to_numpy(float)
    hot_scale, hot_alpha = backoff(hot_total, sums["above"].to_numpy(float), hot_small, sums["mass"].to_numpy(float), d)

    def evaluate(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["docs"] is not None:
                    blobs, at = [], 0
                    while at < len(row["docs"]):
                        n = int.from_bytes(row["docs"][at : at + 8], "little")
                        blobs.append(row["docs"][at + 8 : at + 8 + n])
                        at += 8 + n
                    ids, flags, tokens, known, base = (unpack(b, k) for b, k in zip(blobs, (np.int64, np.uint8, np.int64, np.int64, np.float64), strict=True))
                    yield _sent(row["chunks"][0], pack(np.arange(len(ids), dtype=np.uint32)), pack(base), pack(np.column_stack([ids, flags, tokens, known]).ravel()))
                    continue
                h, of, count, seen, n, above, small, mass = _contexts(row, words)
                scale, alpha = backoff(n, above, small, mass, d)
                if len(hot_h):
                    at = np.minimum(np.searchsorted(hot_h, h), len(hot_h) - 1)
                    spread = hot_h[at] == h
                    n, scale, alpha = np.where(spread, hot_total[at], n), np.where(spread, hot_scale[at], scale), np.where(spread, hot_alpha[at], alpha)
                ratio = np.where(count <= K, d[np.minimum(count, K)], 1.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    log = np.where(count > 0, np.log10(scale[of] * ratio * count / np.maximum(n[of], 1)), np.log10(alpha[of]) + np.log10(words.p(seen)))
                runs, places = unpack(row["runs"], U).astype(np.int64), unpack(row["places"], np.uint32)
                chunk_of = unpack(row["of"], np.uint16 if len(row["chunks"]) < 65536 else np.uint32)
                value = np.repeat(log, runs)
                order, cuts = _by_owner(chunk_of, len(row["chunks"]))
                for k, chunk in enumerate(row["chunks"]):
                    some = order[cuts[k] : cuts[k + 1]]
                    total = np.bincount(places[some], value[some])
                    at = np.flatnonzero(np.bincount(places[some]))
                    yield _sent(chunk, pack(at.astype(np.uint32)), pack(total[at]), None)

    def _sent(chunk, at, value, about):
        return pa.RecordBatch.from_pydict({"chunk": [chunk], "at": [at], "value": [value], "about": [about]}, schema=pa.schema([("chunk", pa.int64()), ("at", pa.binary()), ("value", pa.binary()), ("about", pa.binary())]))

    def finish(batches):
        for _, parts in grouped(batches, ["chunk"]):
            at, value, about = (column(parts, c).to_pylist() for c in ("at", "value", "about"))
            [k] = [i for i, x in enumerate(about) if x is not None]
            ids, flags, tokens, known = unpack(about[k], np.int64).reshape(-1, 4).T
            base, result = unpack(value[k], np.float64), np.zeros(len(ids))
            for i in range(len(at)):
                if i != k:
                    result[unpack(at[i], np.uint32)] += unpack(value[i], np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=flags & 2 > 0), pa.array(flags & 1 == 1), pa.array(tokens), pa.array(known), pa.array(np.full(len(ids), words.total)), pa.array(base), pa.array(result)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    parts = table.drop("words", "hot", "stats").mapInArrow(evaluate, "chunk long, at binary, value binary, about binary")
    dealt = parts.repartition(owners, "chunk").sortWithinPartitions("chunk", F.xxhash64("at", "value"))
    return dealt.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
