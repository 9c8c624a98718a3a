"""Blocks: consecutive windows of a text that share their anchor, the least hash of the shorter strings in them."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa

from .common import mixed, prefix_hashes, span_hashes

#: A text is searched for anchors so many bytes at a time, overlapping by a window.
PIECE_BITS = 18


def byte_column(column):
    """(bytes of all values, where each begins) of an Arrow string column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blocks_of(data, offsets, length, gram, hashes=None):
    """(text, start, windows, offset of the anchor, hash of the anchor, hash of the content) of each
    block in the texts data[offsets[i]:offsets[i + 1]], less than 2**19 bytes in all. hashes: a
    function of the hashes of spans, if data are no bytes."""
    bits = PIECE_BITS + 1
    m = len(data) - length + 1
    if m <= 0:
        return [np.zeros(0, np.int64)] * 6
    hashes = hashes or partial(span_hashes, prefix_hashes(data))
    at = np.arange(len(data) - gram + 1)
    grams = hashes(at, at + gram)
    low = np.uint64((1 << bits) - 1)
    least = (grams & ~low) | at.astype(np.uint64)  # ties go to the leftmost
    w, size = length - gram + 1, 1
    while size * 2 <= w:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    least = np.minimum(least[: m], least[w - size : w - size + m])
    anchor = (least & low).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(m), "right") - 1
    anchor[np.arange(m) + length > offsets[text + 1]] = -1  # windows that leave their text
    first = np.flatnonzero(np.diff(anchor, prepend=-2))
    n = np.diff(np.append(first, m))
    some = anchor[first] >= 0
    first, n = first[some], n[some]
    a = anchor[first]
    content = mixed(hashes(first, first + n - 1 + length) + (a - first).astype(np.uint64))
    return text[first], first - offsets[text[first]], n, a - first, mixed(grams[a]).view(np.int64), content.view(np.int64)
