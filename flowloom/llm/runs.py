"""Runs of repeated words by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q that repeats at
least ``repeats`` times and has at least ``least`` words. Every word of a run
then occurs ``repeats`` times inside it, so a word that is rarer in the segment
at hand belongs to no run and splits the segment. Counting starts again within
the parts until nothing changes; most prose is gone by then. All texts of a
chunk are split together. The surviving segments are scanned lag by lag.

The scan looks at every q-th word for lag q: the equal pairs of a run span at
least (``repeats`` - 1) x q words, so they contain that many such places in a
row. A segment of s words costs s log s comparisons, not s squared, and every
hit is widened to its full extent by comparing words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from flowloom.llm.common import chunks, map_batches
from flowloom.llm.words import byte_table, flat_words

WHITE_SPACE = b" \t\n\x0b\x0c\r"
PAIRS = 1 << 20  # places looked at together in a lag scan


def split(code: np.ndarray, row: np.ndarray, least: int, repeats: int) -> list[tuple[int, int]]:
    """(start, end) of the segments in which every word occurs ``repeats`` times."""
    at = np.arange(len(code))
    segment = row.astype(np.int64)
    width = int(code.max(initial=0)) + 1
    changed = True
    while len(at) and changed:
        _, back, times = np.unique(segment * width + code[at], return_inverse=True, return_counts=True)
        stay = times[back] >= repeats
        changed = not stay.all()
        at, segment = at[stay], segment[stay]
        if not len(at):
            break
        breaks = np.r_[True, (np.diff(at) != 1) | (np.diff(segment) != 0)]
        segment = np.cumsum(breaks) - 1
        long = np.bincount(segment)[segment] >= least
        changed |= not long.all()
        at, segment = at[long], segment[long]
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
    last = np.r_[first[1:], len(at)] - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist()))


def reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of two arrays are equal."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at:at + step] != b[at:at + step][:n - at]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


def scan(word: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, by start, then period."""
    n, found = len(word), []
    longest = n // repeats
    q = 1
    while q <= longest:
        # As many lags at once as give about PAIRS places.
        end, places = q, 0
        while end <= longest and (places == 0 or places + n // end <= PAIRS):
            places += n // end
            end += 1
        lags = np.arange(q, end)
        per = (n - lags - 1) // lags + 1  # places 0, q, 2q, ... below n - q
        lag = np.repeat(lags, per)
        place = (np.arange(len(lag)) - np.repeat(np.cumsum(per) - per, per)) * lag
        same = word[place] == word[place + lag]
        # Places in a row that one run must contain.
        hit, need = same.copy(), repeats - 1
        for k in range(1, need):
            hit[:-k] &= same[k:] & (lag[k:] == lag[:-k])
            hit[-k:] = False
        # Its words in between are equal as well: look at one of them.
        kept = np.flatnonzero(hit)
        if need > 1:
            kept = kept[(word[place[kept] + lag[kept] // 2] == word[place[kept] + lag[kept] + lag[kept] // 2])]
        until = {}
        for p, x in zip(lag[kept].tolist(), place[kept].tolist()):
            if x < until.get(p, 0) or any(p % d == 0 and s <= x and x + p <= s + m for s, m, d in found):
                continue  # inside a stretch already measured, or a multiple of a shorter period
            right = x + reach(word[x:n - p], word[x + p:])
            left = x - reach(word[:x][::-1], word[p:x + p][::-1])
            until[p] = right + 1
            if right - left + p >= max(least, repeats * p):
                found.append((left, right - left + p, p))
        q = end
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(code: np.ndarray, row: np.ndarray, least: int, repeats: int) -> list[tuple[int, int, int]]:
    return [(start + s, m, p) for start, end in split(code, row, least, repeats) for s, m, p in scan(code[start:end], least, repeats)]


def find_runs(docs: DataFrame, least: int = 6, repeats: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``runs`` (structs of start, length, period by start,
    then period) and ``collapsed``: the words without those that any run holds
    after its first period, joined by one space.

    ``repeats`` is at least 2 and words are what white space (space, tab to
    carriage return) separates. NULL, empty and blank texts have no words, no
    run and an empty ``collapsed``; repeated rows are returned as often as they
    occur, a NULL id stays NULL, other columns are ignored. No run crosses rows.
    """
    if repeats < 2 or least < 2:
        raise ValueError("a run has at least two repeats and two words")
    table = byte_table(WHITE_SPACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            words = flat_words(batch.column("_text"), table)
            edges = np.r_[0, np.cumsum(words.count)]
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            drop = np.zeros(len(words.code), bool)
            for s, m, p in runs_of(words.code, words.row, least, repeats):
                drop[s + p:s + m] = True
                doc = int(words.row[s])
                found[doc].append({"start": s - int(edges[doc]), "length": m, "period": p})
            kept = words.code[~drop]
            left = np.bincount(words.row[~drop], minlength=batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(left)], pa.int32()), words.names.cast(pa.binary()).take(pa.array(kept)))
            joined = pc.binary_join(lists, b" ").cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(words.count, pa.int64()),
                 pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), joined],
                ["_id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS _text"), run,
        f"_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    ).withColumnRenamed("_id", id_col)
