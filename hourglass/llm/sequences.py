"""Viterbi decoding of many sequences at once, in numpy."""

from __future__ import annotations

import numpy as np


def viterbi(scores: np.ndarray, first: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best labels of consecutive sequences.

    ``scores``: one row for each item and a column for each label; ``first``:
    the first item of each sequence, and the total; ``transition``: the gain
    of label j after label i.  All sequences take a step together.  Ties: the
    smaller label.
    """
    n, labels = scores.shape
    out, back = np.zeros(n, np.int16), np.zeros((n, labels), np.int16)
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, start = lengths[order], first[:-1][order]
    start, lengths = start[lengths > 0], lengths[lengths > 0]
    if not len(start):
        return out
    # how many sequences are longer than t
    running = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    best = scores[start].astype(np.float64)
    for t in range(1, int(lengths[0])):
        m = running[t]
        step = best[:m, :, None] + transition[None]
        came = step.argmax(1)
        back[start[:m] + t] = came
        best[:m] = np.take_along_axis(step, came[:, None], 1)[:, 0] + scores[start[:m] + t]
    label = best.argmax(1)
    for t in range(int(lengths[0]) - 1, -1, -1):
        m = running[t]
        out[start[:m] + t] = label[:m]
        label[:m] = back[start[:m] + t, label[:m]] if t else label[:m]
    return out
