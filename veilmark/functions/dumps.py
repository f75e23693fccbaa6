"""Cells of spreadsheet dumps (the preview grammar), read from the bytes of many dumps at once.

A line begins at the first character after white space with a line break in it (or the
start of the dump) and ends before the next such run; white space is Unicode's, as in the
patterns of :mod:`veilmark.operators.sheets`.  Work and memory follow the bytes of a run
of dumps, not their lines times Python calls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from veilmark.functions import rules as R

#: Bytes of dumps that a task holds in work arrays at a time.
RUN_BYTES = 4 << 20
# the functions travel to the tasks with these values, so workers need not find the package
_PREFIX, _MAX_ROW, _MAX_COL = R.SHEET_HEADER_PREFIX.encode(), R.SHEET_MAX_ROW, R.SHEET_MAX_COL
#: Digits of the last row.
_ROW_DIGITS = len(str(_MAX_ROW))
_BREAKS = np.isin(np.arange(256), [0x0A, 0x0B, 0x0C, 0x0D])
_ASCII_SPACE = _BREAKS | np.isin(np.arange(256), [0x09, 0x20])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_DIGIT = np.isin(np.arange(256), range(48, 58))
# white space of several bytes; line breaks among it
_WIDE = {s.encode(): s in "\x85\u2028\u2029" for s in "\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"}


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(off), pa.py_buffer(data[_places(starts, lengths)]))


def _spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is a byte part of white space, of a line break)."""
    space, breaks = _ASCII_SPACE[data], _BREAKS[data]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        padded = np.append(data, np.zeros(3, np.uint8))
        for raw, is_break in _WIDE.items():
            at = lead[padded[lead] == raw[0]]
            for k in range(1, len(raw)):
                at = at[padded[at + k] == raw[k]]
            for k in range(len(raw)):
                space[at + k] = True
                breaks[at + k] = is_break
    return space, breaks


def cells_of(data: np.ndarray, off: np.ndarray, default_sheet: str) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, pa.Array]:
    """(dump, section, sheet, row, col, value) of the cells of dumps, by dump, section, row and column; of equal places the last line."""
    space, breaks = _spaces(data)
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = space[1:] != space[:-1]
    edge[off] = True
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    blank = space[begin]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    first = first[begin]
    # white space that parts lines
    parting = blank & (first | (np.add.reduceat(breaks, begin, dtype=np.int64) > 0)) if len(begin) else blank
    words = np.flatnonzero(~blank)
    opens = first[words] | parting[words - 1]
    heads = np.flatnonzero(opens)
    start, stop = begin[words[heads]], end[words[np.append(heads[1:], len(words)) - 1]] if len(heads) else begin[:0]
    dump = np.searchsorted(off, start, "right") - 1

    def char(at: np.ndarray) -> np.ndarray:
        return data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(len(at), np.uint8)

    # headers
    prefix = np.frombuffer(_PREFIX, np.uint8)
    header = (char(start) == prefix[0]) & (char(stop - 1) == ord("]")) & (stop - start > len(prefix))
    for k in range(1, len(prefix)):
        header &= char(start + k) == prefix[k]
    a, b = start[header] + len(prefix), stop[header] - 1
    seg = np.searchsorted(begin, a, "right") - 1
    a = np.where((a < b) & blank[seg], end[seg], a)
    seg = np.searchsorted(begin, b - 1, "right") - 1
    b = np.maximum(a, np.where((a < b) & blank[seg], begin[seg], b))
    names = pa.concat_arrays([_strings(data, a, b), pa.array([default_sheet], pa.string())])
    so_far = np.cumsum(header)
    before = np.concatenate([[0], so_far])[np.searchsorted(start, off[:-1])]  # headers of the dumps before
    section = so_far - before[dump]

    # cell lines: one to three letters and a number up to the first colon
    colons = np.flatnonzero(data == ord(":"))
    at = np.searchsorted(colons, start)
    colon = np.append(colons, len(data))[at]
    is_letter = [_LETTER[char(start + k)] for k in range(4)]
    letters = is_letter[0] * (1 + is_letter[1] * (1 + is_letter[2].astype(np.int64)))
    digits = colon - start - letters
    ok = ~header & (colon < stop) & (letters > 0) & ~((letters == 3) & is_letter[3]) & (digits > 0)
    ok[ok] = _DIGIT[data[(start + letters)[ok]]]
    line = np.flatnonzero(ok)
    start, stop, colon, letters, digits = start[line], stop[line], colon[line], letters[line], digits[line]
    row, ok = np.zeros(len(line), np.int64), np.ones(len(line), bool)
    for k in range(_ROW_DIGITS):
        byte = char(np.maximum(colon - 1 - k, 0))
        inside = digits > k
        ok &= ~inside | _DIGIT[byte]
        row += np.where(inside, (byte.astype(np.int64) - 48) * 10**k, 0)
    # longer numbers are rows only if they begin with zeros
    long = np.flatnonzero(ok & (digits > _ROW_DIGITS))
    if len(long):
        more = digits[long] - _ROW_DIGITS
        zero = data[_places((start + letters)[long], more)] == ord("0")
        ok[long] = np.logical_and.reduceat(zero, np.cumsum(more) - more)
    col = np.zeros(len(line), np.int64)
    for k in range(3):
        col = np.where(letters > k, col * 26 + (char(start + k) & 0xDF).astype(np.int64) - 64, col)
    ok &= (row <= _MAX_ROW) & (col <= _MAX_COL)
    line, row, col, stop, value = line[ok], row[ok], col[ok], stop[ok], colon[ok] + 1

    # of lines of one place the last; a section's number among all and its dump's make one number
    place = (so_far[line] + dump[line]) << 36 | row << 15 | col
    order = np.argsort(place, kind="stable")
    ranked = place[order]
    order = order[np.append(ranked[1:] != ranked[:-1], True)] if len(order) else order
    line, row, col, stop, value = line[order], row[order], col[order], stop[order], value[order]
    solid = np.append(np.flatnonzero(~_ASCII_SPACE[data]), len(data))
    value = np.minimum(solid[np.searchsorted(solid, value)], stop)
    name = np.where(section[line] > 0, so_far[line] - 1, len(names) - 1)
    return dump[line], section[line], names.take(pa.array(name)), row, col, _strings(data, value, stop)


def preview_cells(batches: Iterator[pa.RecordBatch], default_sheet: str) -> Iterator[pa.RecordBatch]:
    """(key, section, sheet, row, col, value) of the cells of dumps (key, text)."""
    for whole in batches:
        sizes = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < whole.num_rows:
            last = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + RUN_BYTES, "right")))
            batch = whole.slice(at, last - at)
            at = last
            text = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            _, off, data = text.buffers()
            off = np.frombuffer(off, np.int64)[text.offset:text.offset + len(text) + 1]
            data = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
            dump, section, sheet, row, col, value = cells_of(data, off - off[0], default_sheet)
            if len(dump):
                yield pa.record_batch([batch.column(0).take(pa.array(dump)), pa.array(section, pa.int32()), sheet, pa.array(row, pa.int64()), pa.array(col, pa.int64()), value],
                                      [whole.schema.names[0], "section", "sheet", "row", "col", "value"])
