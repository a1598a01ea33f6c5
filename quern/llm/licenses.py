"""License scans: short notices with a bounded number of edits.

A text is lower-cased (A-Z) and its words are joined by single spaces.  A notice with up
to k edits is split into k + 1 pieces, one of which must stand in the text unchanged; an
automaton over all pieces finds these places, and the regex library's bounded-error
matching verifies a window around each and reports the span and its edits.  Spans stand at
word borders.  A phrase that allows no edits is its own single piece.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

#: Exact phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices, their labels, and the edits (characters put in, left out or exchanged) each allows.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache-2.0", 4),
    ("permission is hereby granted free of charge", "mit", 4),
    ("the mit license", "mit", 1),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("gnu general public license", "gpl", 3),
    ("general public license", "gpl", 2),
    ("gnu lesser general public license", "lgpl", 3),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("licensed under cc by", "cc-by", 2),
    ("released into the public domain", "public-domain", 3),
    ("all rights reserved", "reserved", 2),
    ("no part of this publication may be reproduced", "reserved", 4),
    ("spdx license identifier", "spdx", 2),
]
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Scanner:
    """Finds phrases and notices; a notice's spans begin and end at word borders and don't overlap, the ones of fewest edits first."""

    def __init__(self, base: dict = BASE, notices: list = NOTICES) -> None:
        rules = [(phrase, label, 0) for phrase, label in base.items()] + list(notices)
        self.rules, self.automaton = [], ahocorasick.Automaton()
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (phrase, label, edits) in enumerate(rules):
            # the space in front is read too: where a search begins, the library puts no character in
            pattern = None if not edits else regex.compile(rf"(?be) (?:{regex.escape(phrase)}){{e<={edits}}}(?![^ ])")
            self.rules.append((phrase, label, edits, pattern))
            cuts = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(phrase[a:b], []).append((k, a))
        for seed, at in seeds.items():
            self.automaton.add_word(seed, (len(seed), at))
        self.automaton.make_automaton()

    def verified(self, k: int, joined: str, windows: set) -> list[tuple[int, int, int]]:
        """(start, end, edits) of a notice's spans within windows that end at word borders.

        The best match of every window counts unless it overlaps a better one; then what that leaves of the window is searched too.
        """
        phrase, _, edits, pattern = self.rules[k]
        kept: list[tuple[int, int, int]] = []
        padded = " " + joined
        while windows:
            found = []
            for lo, hi in windows:
                if hi - lo >= len(phrase) - edits and (m := pattern.search(padded, lo, hi + 1)):
                    found.append((sum(m.fuzzy_counts), m.start(), m.end() - 1, lo, hi))
            windows = set()
            for n, start, end, lo, hi in sorted(found):
                over = [(a, b) for a, b, _ in kept if a < hi and lo < b]
                if not any(a < end and start < b for a, b in over):
                    kept.append((start, end, n))
                elif (start, end, n) not in kept:
                    edge = lo
                    for a, b in [*sorted(over), (hi + 1, hi)]:  # spans end at word borders, so what is left does, without the space between
                        windows.add((edge, min(a - 1, hi)))
                        edge = max(edge, b + 1)
            windows = {(lo, hi) for lo, hi in windows if hi > lo}
        return kept

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, int, bool]], str]:
        """(words, spans, joined words): a span is (first character, end, label, edits, whether it is a base phrase's) in the joined words."""
        words = text.translate(WORDS).split()
        joined = b" ".join(words).decode()
        size = len(joined)
        windows: dict[int, set] = {}
        spans = []
        for end, (n, rules) in self.automaton.iter(joined):
            start = end + 1 - n
            for k, offset in rules:
                phrase, label, edits, pattern = self.rules[k]
                if pattern is None:
                    if (not start or joined[start - 1] == " ") and (end + 1 == size or joined[end + 1] == " "):
                        spans.append((start, end + 1, label, 0, True))
                    continue
                lo, hi = max(0, start - offset - edits), min(size, start - offset + len(phrase) + edits)
                if lo and joined[lo - 1] != " ":
                    lo = joined.find(" ", lo, hi) + 1 or hi
                if hi < size and joined[hi] != " ":
                    hi = joined.rfind(" ", lo, hi)
                if hi - lo >= len(phrase) - edits:
                    windows.setdefault(k, set()).add((lo, hi))
        for k, held in windows.items():
            spans += [(start, end, self.rules[k][1], n, False) for start, end, n in self.verified(k, joined, held)]
        return len(words), sorted(spans), joined


def summary(found: tuple) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    n, spans, joined = found
    base = [s for s in spans if s[4]]
    at = (joined.count(" ", 0, base[0][0]), joined.count(" ", 0, base[-1][0])) if base else (None, None)
    # a text is license text by its surest span: an exact phrase counts 1, one with edits less
    score = max([1.0 if b else max(0.0, 1 - e / max(1, end - start) * 3) for start, end, _, e, b in spans], default=0.0)
    return n, len(base), *at, ",".join(sorted({s[2] for s in base})), ",".join(sorted({s[2] for s in spans})), score


def scan_licenses(docs: DataFrame, keep: list[str], with_spans: bool = False) -> DataFrame:
    """The ``keep`` columns, the summary of every text, and with_spans all spans; null and empty texts have none.

    Every row has its own, those of equal ids or texts too; very long texts are scanned whole; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    columns = [*keep, "text"] if "text" not in keep else keep
    at = columns.index("text")
    added = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    if with_spans:
        added["spans"] = "array<struct<start:int,end:int,label:string,edits:int,base:boolean>>"
        kinds.append(pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("edits", pa.int32()), ("base", pa.bool_())])))
    schema = docs.select(*keep, *(F.lit(None).cast(t).alias(c) for c, t in added.items())).schema

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                found = scanner.scan(text or b"")
                row = summary(found)
                rows.append((*row, [dict(zip(("start", "end", "label", "edits", "base"), s, strict=True)) for s in found[1]]) if with_spans else row)
            got = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *got], names=[*keep, *added])

    return docs.select(*columns).mapInArrow(run, schema)
