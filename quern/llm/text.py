"""Words of many texts at once, as arrays: places and 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Bytes worked on at once; the arrays take about 40 bytes for each.
PIECE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space separates: all but 0x20 and 0x09-0x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


#: Bits of the first n bytes of a 64-bit word.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=U)
#: Words of more bytes are hashed one by one.
LONG = 256


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty texts."""
    texts = texts.fill_null("").cast(pa.large_binary())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return body, at - at[0]


def pieces(body: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Cut into about PIECE bytes at text ends, or in a longer text at bytes that aren't inside words: (bytes, offsets, first text)."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE, "right")) - 1)
        start, end = int(at[first]), int(at[last])
        if last == first + 1 and end - start > 2 * PIECE:
            while start < end:
                cut = min(end, start + PIECE)
                while cut < end:
                    gap = np.flatnonzero(~inside[body[cut : cut + PIECE]])
                    cut = min(end, cut + (int(gap[0]) if len(gap) else PIECE))
                    if len(gap):
                        break
                yield body[start:cut], np.array([0, cut - start]), first
                start = cut
        else:
            yield body[start:end], at[first : last + 1] - start, first
        first = last


def words(body: np.ndarray, at: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, length in bytes) of every word in order; bytes are lower-cased, words end with their text.

    A hash is made of a word's length and its bytes, eight at a time, each step a bijection of the
    hash so far and the bytes: words of up to eight bytes have different hashes, longer ones
    equal ones with a chance of 2^-64 a pair, whatever their pattern.  Words of more than LONG bytes have their XXH64.
    """
    none = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(body):
        return none
    low = LOWER[body]
    is_word = inside[low]
    edge = np.zeros(len(body) + 1, dtype=bool)
    edge[at] = True
    border = np.empty(len(body) + 1, dtype=bool)  # between a byte and the next: a text ends, or a word does
    border[0] = border[-1] = True
    border[1:-1] = edge[1:-1] | (is_word[1:] != is_word[:-1])
    starts = np.flatnonzero(border[:-1] & is_word)
    if not len(starts):
        return none
    length = np.flatnonzero(border[1:] & is_word) + 1 - starts
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(low) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    value = mix(length.astype(U) * U(0x9E3779B97F4A7C15))
    todo, done = np.flatnonzero(length <= LONG), 0
    while len(todo):
        left = length[todo] - done
        value[todo] = mix(value[todo] ^ (lanes[starts[todo] + done] & FIRST[np.minimum(left, 8)]))
        done += 8
        todo = todo[left > 8]
    for k in np.flatnonzero(length > LONG):
        value[k] = xxhash.xxh64_intdigest(low[starts[k] : starts[k] + length[k]].tobytes(), 42)
    return value, np.searchsorted(at, starts, "right") - 1, length


def batch_words(texts: pa.Array, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words() of a whole Arrow column."""
    found = []
    for body, at, first in pieces(*raw(texts)):
        h, doc, length = words(body, at, inside)
        found.append((h, doc + first, length))
    if not found:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
