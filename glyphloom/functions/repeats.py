"""Repeats inside pieces: runs of equal characters and of equal units, over code-point arrays.

From left to right, a run of three or more equal characters is one segment; else
three or more copies of the shortest unit of 2 to ``PARAM_MAX`` characters are;
else a single character is. For each period the places at which a text agrees with
itself so many characters on are compared in one go for all pieces long enough, so a
piece costs time proportional to its length, with the longest unit as the factor.
"""

import numpy as np
import pyarrow as pa

from glyphloom.functions import patterns as p

OP = pa.struct([("op", pa.int32()), ("params", pa.list_(pa.int32()))])
PARTS = pa.struct([("text", pa.string()), ("ops", pa.list_(OP))])


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts (nulls are empty) and the bounds of each text's."""
    whole = texts.fill_null("").to_pylist()
    sizes = np.fromiter(map(len, whole), np.int64, len(whole))
    return (np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32),
            np.concatenate(([0], np.cumsum(sizes))))


def _agreeing(points: np.ndarray, ends: np.ndarray, period: int) -> np.ndarray:
    """For each place, how many characters from there on equal the ones ``period`` later in the same text."""
    n = len(points)
    same = np.zeros(n, bool)
    same[:n - period] = points[:n - period] == points[period:]
    same &= np.arange(n) + period < ends
    stops = np.flatnonzero(~same)
    return np.append(stops, n)[np.searchsorted(stops, np.arange(n))] - np.arange(n)


def segments(texts: pa.Array) -> dict[int, list[tuple[int, int, int]]]:
    """(start, size of the unit, copies) of every repeat, by row; rows without any are left out."""
    points, bounds = code_points(texts)
    sizes = np.diff(bounds)
    found: dict[int, dict[int, tuple[int, int]]] = {}
    for period in range(1, min(p.PARAM_MAX, int(sizes.max()) // 3 if len(sizes) else 0) + 1):
        rows = np.flatnonzero(sizes >= 3 * period)
        if not len(rows):
            break
        size = sizes[rows]
        inside = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(owner)) - inside[owner]
        agree = _agreeing(points[bounds[rows][owner] + place], (inside + size)[owner], period)
        for k in np.flatnonzero(agree >= 2 * period).tolist():
            found.setdefault(int(rows[owner[k]]), {}).setdefault(int(place[k]), (period, 1 + int(agree[k]) // period))
    out = {}
    for row, starts in found.items():
        at, kept = 0, []
        for start in sorted(starts):
            if start >= at:
                period, copies = starts[start]
                kept.append((start, period, copies))
                at = start + period * copies
        out[row] = kept
    return out


def folded(text: str, repeats: list[tuple[int, int, int]]) -> tuple[str, list[dict]]:
    """The text with its repeats folded, and the operators for them.

    A repeat folds if its copies and its place in the folded text fit a parameter;
    segments beyond the largest place stay as they are.
    """
    out, ops, at, last, seen = [], [], 0, 0, 0
    for start, size, copies in repeats:
        seen += start - last            # single characters are segments too
        if seen > p.PARAM_MAX:
            break
        out.append(text[last:start])
        at += start - last
        last = start + size * copies
        seen += 1
        fits = at <= p.PARAM_MAX if size == 1 else at + size <= p.PARAM_MAX
        if copies <= p.PARAM_MAX and fits:
            params = [at, copies] if size == 1 else [at, at + size, copies]
            ops.append({"op": p.REPEAT if size == 1 else p.MULTIREPEAT, "params": params})
            out.append(text[start:start + size])
            at += size
        else:
            out.append(text[start:last])
            at += size * copies
    return "".join(out) + text[last:], ops


def parts(texts: pa.Array) -> pa.Array:
    """(text, ops) of every piece that holds a repeat; null for the others."""
    rows: list = [None] * len(texts)
    for row, repeats in segments(texts).items():
        text, ops = folded(texts[row].as_py(), repeats)
        rows[row] = {"text": text, "ops": ops}
    return pa.array(rows, PARTS)
