"""SentencePiece (BPE models) encoding by a merge-type prefix table, and decoding.

For every prefix of a text the encoding has one last token.  An Aho-Corasick automaton
reports the vocabulary pieces that end at a place, longest first; the one whose
predecessor, the last token of the prefix before it, may stand next to it is the
last token there.  Two pieces may stand together if undoing their merges, latest first,
never shows a merge across their border that would have come earlier.  The ids are then
recovered from the end backwards.  No piece has a space mark behind another character, so
a text is cut in front of its space marks and the cuts' ids are kept in a bounded memo.
Runs of space marks merge with equal scores, leftmost first, which a prefix table can't
tell apart; cuts with such runs are merged step by step.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

MARK = "▁"
#: Entries of each of a worker's memos.  A full one becomes the old one, whose entries return as they are used.
MEMO = 350_000
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            n = varint()
            yield tag >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if n == 4 else "<d", raw[at : at + n])[0]
            at += n


class Pieces:
    """A BPE model file with byte fallback, identity normalisation and a dummy prefix, as such models commonly have."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(3, 1) != 2:
                raise ValueError("not a BPE model")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2) or spec.get(3, 1) != 1 or spec.get(4, 1) != 0 or spec.get(5, 1) != 1:
                    raise ValueError("the model's normalisation isn't supported")
        self.bos = self.pieces.index("<s>")
        self.eos = self.pieces.index("</s>")
        self.unk = self.kinds.index(UNKNOWN)
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        order = sorted(self.ids.values(), key=lambda i: -scores[i])
        self.rank = {i: r for r, i in enumerate(order)}
        for r, i in enumerate(order[1:], 1):  # equal scores merge leftmost first
            if scores[i] == scores[order[r - 1]]:
                self.rank[i] = self.rank[order[r - 1]]
        self.split: dict[int, tuple[int, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, i in sorted(self.ids.items(), key=lambda x: len(x[0])):
            if len(piece) > 1:
                found, last = self._merged(piece)
                if found != [i]:
                    continue  # no sequence of merges makes it
                self.split[i] = last
            if MARK * 2 not in piece:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.cuts = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n" if "\n" not in "".join(self.ids) else rf"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.plain = re.compile("[" + "".join(map(re.escape, (p for p in self.ids if len(p) == 1))) + "]+")
        self.surface = [b"" if k in (CONTROL,) else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        for b, i in enumerate(self.bytes):
            self.surface[i] = bytes([b])
        self.surface[self.unk] = " ⁇ ".encode()

    def _merged(self, text: str) -> tuple[list[int], tuple[int, int] | None]:
        """Merge step by step, best score first, leftmost of equals: (ids, the last merge)."""
        parts, last = list(text), None
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                r = self.rank.get(self.ids.get(parts[k] + parts[k + 1], -1))
                if r is not None and (best is None or r < best[0]):
                    best = (r, k)
            if best is None:
                break
            k = best[1]
            if len(parts) == 2:
                last = (self.ids.get(parts[0], -1), self.ids.get(parts[1], -1))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids.get(p, -1) for p in parts], last

    def _stands(self, a: int, b: int) -> bool:
        """Whether a then b stay apart when their text is merged."""
        key = a << 32 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO:
                self.compatible.clear()
            known = self.compatible[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # The merges that made the border's two tokens, latest first.  While undoing one, the
        # pair that is then at the border must not have been mergeable before it: on equal
        # ranks the left one of two merges comes first.
        limit, of_left = len(self.rank) + 1, False
        while True:
            merged = self.ids.get(self.pieces[a] + self.pieces[b])
            if merged is not None and (merged in self.split or len(self.pieces[merged]) == 2):
                r = self.rank[merged]
                if r < limit or (r == limit and not of_left):
                    return False
            ra = self.rank[a] if a in self.split else -1
            rb = self.rank[b] if b in self.split else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, of_left, a = ra, True, self.split[a][1]
            else:
                limit, of_left, b = rb, False, self.split[b][0]

    def _table(self, text: str) -> list[int]:
        """Ids of a run of known characters by the prefix table."""
        last = [-1] * (len(text) + 1)
        size = [0] * (len(text) + 1)
        stands = self._stands
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if size[end]:
                continue
            if end == n or stands(last[end - n], token):
                last[end], size[end] = token, n
        ids = []
        at = len(text)
        while at:
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _cut(self, text: str) -> bytes:
        """Ids of a cut, packed."""
        ids: list[int] = []
        at = 0
        for run in self.plain.finditer(text):
            for c in text[at : run.start()]:
                ids += (self.bytes[b] for b in c.encode())
            ids += self._table(run[0]) if MARK * 2 not in run[0] else self._slow(run[0])
            at = run.end()
        for c in text[at:]:
            ids += (self.bytes[b] for b in c.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _slow(self, text: str) -> list[int]:
        """Ids of a cut that starts with a run of marks; runs are halved by merging left to right in rounds, not searched anew each time."""
        if len(text) <= 64:
            return self._merged(text)[0]
        import heapq

        parts: list = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list = []

        def offer(i):
            j = right[i]
            if j < len(parts) and (r := self.rank.get(self.ids.get(parts[i] + parts[j], -1))) is not None:
                heapq.heappush(heap, (r, i, j, len(parts[i]) + len(parts[j])))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, n = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or right[i] != j or len(parts[i]) + len(parts[j]) != n:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            if left[i] >= 0:
                offer(left[i])
            offer(i)
        return [self.ids[p] for p in parts if p is not None]

    def encode(self, text: str, ends: bool = True) -> bytes:
        """All ids as little-endian unsigned 32-bit integers."""
        found: list = []
        if text:
            cuts = self.cuts.findall(MARK + text.replace(" ", MARK))
            found = list(map(self.memo.get, cuts))
            if None in found:
                for k, ids in enumerate(found):
                    if ids is None:
                        found[k] = self._kept(cuts[k])
        body = b"".join(found)
        return struct.pack("<I", self.bos) + body + struct.pack("<I", self.eos) if ends else body

    def _kept(self, cut: str) -> bytes:
        ids = self.memo.get(cut) or self.old.get(cut) or self._cut(cut)
        if len(cut) <= 64:
            if len(self.memo) >= MEMO:
                self.old, self.memo = self.memo, {}
            self.memo[cut] = ids
        return ids

    def decode(self, ids: bytes) -> str:
        """The text of packed ids: one leading space is the dummy prefix's; bytes that aren't UTF-8 become U+FFFD."""
        surface = self.surface
        numbers = np.frombuffer(ids, dtype="<u4").tolist()
        body = b"".join([surface[i] for i in numbers])
        first = next((i for i in numbers if self.kinds[i] != CONTROL), None)
        if first is not None and self.kinds[first] == NORMAL and self.pieces[first][0] == MARK:
            body = body[1:]
        return body.decode("utf-8", errors="replace")


_loaded: dict[bytes, Pieces] = {}


def load(model: bytes) -> Pieces:
    """The model of a worker, made once."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Pieces(model)
    return _loaded[key]


def encode_decode(docs: DataFrame, model_path: str, keep: list[str], digests: bool = False) -> DataFrame:
    """The ``keep`` columns with ids (array) and decoded text, or with digests their count and hashes.

    Null and empty texts are encoded as the begin and end ids and decoded as "".  The model
    is read on the driver and travels with the task.
    """
    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    if digests:
        added = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    else:
        added = {"ids": "array<int>", "decoded": "string"}
    schema = docs.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches):
        pieces = load(model)
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                ids = pieces.encode(text or "")
                decoded = pieces.decode(ids)
                if digests:
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
                else:
                    rows.append((np.frombuffer(ids, dtype="<u4").astype(np.int32), decoded))
            kinds = [pa.int64(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.string()]
            found = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *found], names=[*keep, *added])

    return docs.select(*columns).mapInArrow(run, schema)
