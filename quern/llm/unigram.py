"""Token counts under a unigram model, by a trie of distinct pre-tokens.

A pre-token is a space mark and a word.  Its best segmentation maximises the sum of its
pieces' log probabilities, found by forward scores from its start; a forward score
depends only on the prefix read so far.  Distinct pre-tokens are therefore walked as a trie,
in sorted order with a stack of prefixes, each shared prefix scored once, and the counts at
their ends are stored.  Of equal scores the segmentation with fewer pieces counts.  Memory is bounded
by bytes, not by words: texts without spaces are single words of any length, and words of more
than LONG characters are scored alone, on the forward scores that a piece can still reach.

The pieces are a public vocabulary's; their probabilities follow Zipf's law in the order
of their scores, since the tokenizer itself is not trained here.  A character that is no
piece counts as its UTF-8 bytes, each less likely than any piece.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import MARK, NORMAL, _fields
from .store import small_batches

#: Bytes of words whose counts a worker keeps; a full memo becomes the old one.
MEMO = 80_000_000
#: Bytes that a word takes in the memo beside its own.
ENTRY = 100
#: Characters of the longest words that are walked and kept.
LONG = 256
#: Characters of text split into words at once, and words of a longer text.
PIECE, WORDS = 1 << 21, 1 << 18
#: The words of str.split().
WORD = re.compile(r"\S+")
#: Characters of a long word between two cuts of its forward scores.
STEP = 4096


def vocabulary(model: bytes) -> dict[str, float]:
    """Log probabilities of the normal pieces of a SentencePiece model file."""
    found = []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            if piece.get(3, NORMAL) == NORMAL:
                found.append((-piece.get(2, 0.0), piece[1].decode()))
    found.sort()
    total = math.log(sum(1 / (r + 2) for r in range(len(found))))
    return {p: -math.log(r + 2) - total for r, (_, p) in enumerate(found)}


def portions(texts: Iterable[str]) -> Iterator[list[tuple[int, list[str]]]]:
    """(text number, words) of about PIECE characters at a time; a longer text comes in several."""
    held, size = [], 0
    for row, text in enumerate(texts):
        parts = [text.split()] if len(text) <= PIECE else map(list, batched((m.group() for m in WORD.finditer(text)), WORDS))
        for part in parts:
            held.append((row, part))
            size += min(len(text), PIECE)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Counter:
    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.longest = max(map(len, scores))
        self.byte = min(scores.values()) - 10
        self.memo: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.size = 0  # bytes of memo

    def extend(self, text: str, begin: int, stop: int, best: list[float], many: list[int], base: int = 0) -> None:
        """Append the forward scores and piece counts of text's prefixes of begin + 1 to stop characters; the lists start at the prefix of base."""
        get, longest, byte = self.scores.get, self.longest, self.byte
        for end in range(begin + 1, stop + 1):
            top, n = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = get(text[start:end])
                if score is not None:
                    score += best[start - base]
                    if score > top or (score == top and many[start - base] + 1 < n):
                        top, n = score, many[start - base] + 1
            if top == -math.inf:
                size = len(text[end - 1].encode())
                top, n = best[-1] + byte * size, many[-1] + size
            best.append(top)
            many.append(n)

    def walk(self, words: Iterable[str]) -> dict[str, int]:
        """Counts of distinct words, walked as a trie in sorted order."""
        counts, last = {}, ""
        best, many = [0.0], [0]  # forward score and piece count of each prefix of MARK + last
        for word in sorted(words):
            text = MARK + word
            shared = 0
            for a, b in zip(last, text, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], many[shared + 1 :]
            self.extend(text, shared, len(text), best, many)
            counts[word] = many[-1]
            last = text
        return counts

    def alone(self, word: str) -> int:
        """The count of one word of any length; of its forward scores the last ones are held."""
        text, best, many, base = MARK + word, [0.0], [0], 0
        for begin in range(0, len(text), STEP):
            self.extend(text, begin, min(len(text), begin + STEP), best, many, base)
            gone = max(0, len(best) - self.longest)
            del best[:gone], many[:gone]
            base += gone
        return many[-1]

    def count(self, texts: list[list[str]]) -> list[int]:
        """Sums of the counts of each text's words."""
        every = set().union(*texts)
        long = {w: self.alone(w) for w in every if len(w) > LONG}
        every -= long.keys()
        new = every - self.memo.keys()
        size = sum(map(sys.getsizeof, new)) + ENTRY * len(new)
        if self.memo and self.size + size > MEMO:
            self.old, self.memo, new = self.memo, {}, every
            self.size, size = 0, sum(map(sys.getsizeof, new)) + ENTRY * len(new)
        known = {w: self.old[w] for w in new & self.old.keys()}
        self.memo |= known | self.walk(new - known.keys())
        self.size += size
        get = ({w: self.memo[w] for w in every} | long if long else self.memo).__getitem__
        return [sum(map(get, t)) for t in texts]

    def totals(self, texts: list[str]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        words, tokens = [0] * len(texts), [0] * len(texts)
        for held in portions(texts):
            for (row, part), found in zip(held, self.count([part for _, part in held]), strict=True):
                words[row] += len(part)
                tokens[row] += found
        return words, tokens


_loaded: dict[bytes, Counter] = {}


def load(model: bytes) -> Counter:
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Counter(vocabulary(model))
    return _loaded[key]


def count_tokens(docs: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, n_words and n_tokens of every text; null and empty texts have 0.

    Repeated rows and ids are counted each for itself, very long texts whole, other columns aren't
    read, and an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches):
        counter = load(model)
        for batch in batches:
            words, tokens = counter.totals([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*keep, "n_words", "n_tokens"])

    return docs.select(*columns).mapInArrow(run, schema)
