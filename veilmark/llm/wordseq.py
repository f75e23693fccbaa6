"""Word numbers of whole texts: what the operators on word sequences share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from veilmark.llm.common import pieces_of


def word_numbers(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct pieces, number of each word's piece, first byte of each word, first word of each text and the end).

    ``inside`` says which bytes belong to words; a word never crosses a text.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[off] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    distinct, index = pieces_of(data, cuts)
    word = inside[cuts[:-1]]
    begin = cuts[:-1][word]
    return distinct, index[word], begin, np.searchsorted(begin, off, "left")
