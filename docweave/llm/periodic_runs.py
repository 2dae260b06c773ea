"""Runs of words that repeat with a period, in every text.

A run is a maximal repetition of words: a stretch with a smallest period whose
neighbours do not continue it.  Runs come from the Lyndon arrays of the text under
both orders (``lyndon``).  A text is first cut where no run can be: a
repetition of many periods has every three of its neighbouring words several
times, so the stretches between places where that fails are searched apart.
This loses no run and cuts none, since a run and all that could continue it lie in
one stretch; ordinary prose leaves little to search.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import map_batches
from docweave.llm.lyndon import repetitions

_U = np.uint64
_MIX = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
RUNS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                     T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def _repeating(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, times: int,
               least: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the stretches [starts, ends) in which every three neighbouring words come ``times`` times or more.

    Counts are those of a hash, so a clash can only leave more to search.
    """
    sizes = ends - starts
    n = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    at = np.arange(n) + np.repeat(starts - before, sizes)
    own = np.repeat(np.arange(len(sizes)), sizes)
    if n < 3:
        return starts[:0], ends[:0]
    w = words[at].astype(_U)
    key = w[:-2] * _MIX[0] + w[1:-1] * _MIX[1] + w[2:] * _MIX[2] + own[2:].astype(_U) * _MIX[3]
    key = (key ^ (key >> _U(29))) * _MIX[1]
    inside = own[:-2] == own[2:]
    _, which, many = np.unique(key[inside], return_inverse=True, return_counts=True)
    often = np.zeros(n, bool)
    often[:-2][inside] = many[which] >= times
    # The last two words of a stretch begin no three, so stretches stay apart.
    edge = np.flatnonzero(np.diff(often.astype(np.int8), prepend=0, append=0))
    first, last = edge[::2], edge[1::2]
    begin, end = at[first], at[last - 1] + 3
    long = end - begin >= least
    return begin[long], end[long]


def runs_of(words: np.ndarray, ends: list[int], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text; ``words`` are the texts' word numbers one after the other."""
    bounds = np.array([0, *ends], np.int64)
    starts, stops = bounds[:-1], bounds[1:]
    times = exponent - 1 if least > exponent else exponent - 2
    if times > 1:
        left = None
        while left is None or int((stops - starts).sum()) < 0.9 * left:
            left = int((stops - starts).sum())
            starts, stops = _repeating(words, starts, stops, times, least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    text = np.searchsorted(bounds, starts, side="right") - 1
    for i, j, k in zip(starts.tolist(), stops.tolist(), text.tolist()):
        if j > i:
            _, symbols = np.unique(words[i:j], return_inverse=True)
            shift = i - int(bounds[k])
            out[k].extend((s + shift, n, p) for s, n, p in repetitions(symbols.astype(np.int64), exponent, least))
    return out


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def periodic_runs(docs: DataFrame, exponent: int = 4, least: int = 6, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    ``runs`` are (start, length, period), counted in words from 0, of the
    repetitions with length >= max(``least``, ``exponent`` * period), by start and
    then period; ``exponent`` is 2 or more.  ``collapsed`` has the words that no run
    holds after its first period, joined by one space.  Words are runs of
    non-blanks and equal byte by byte; a null, empty or blank text has no words,
    no runs and an empty ``collapsed``.  Every row is on its own: ids may be null or
    repeat.  Texts are read whole; an empty table gives an empty result; other
    columns are not read.
    """
    if exponent < 2:
        raise ValueError("a repetition has two periods or more")

    def search(batch: pa.RecordBatch) -> dict:
        number: dict[bytes, int] = defaultdict(count().__next__)
        texts, ends, codes, n = [], [], [], 0
        for text in batch.column("text"):
            words = (text.as_py() or b"").split()
            texts.append(words)
            codes.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
            n += len(words)
            ends.append(n)
        runs = runs_of(np.concatenate([np.empty(0, np.int64), *codes]), ends, exponent, least)
        whole = pa.array([collapse(w, r) for w, r in zip(texts, runs)], pa.binary()).cast(pa.string())
        spans = [[{"start": s, "length": m, "period": p} for s, m, p in r] for r in runs]
        return {"doc_id": batch.column("doc_id"), "n_words": [len(w) for w in texts], "runs": spans,
                "collapsed": whole}

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("binary").alias("text"))
    return map_batches(rows, search, RUNS, rows=256)
