"""Removal of repeated byte strings by deep-shallow sorting of suffixes.

Every string of ``length`` bytes contains an anchor: the place with the least
hash among its first ``WINDOW`` places. Equal strings have their anchor at the
same offset, so equal strings meet when anchors with an equal *core* (the bytes
from the anchor on that all its strings share) meet.

1. Anchors of all texts are found (about one per WINDOW / 2 bytes).
2. Counts per core, then per whole run of strings, combined before the shuffle,
   settle most of them: a core that occurs once has no partner, and a run whose
   bytes occur twice repeats as a whole. Copies of any number are one row here.
3. What remains are the borders of repeated passages. Their suffixes to the
   right of the anchor and their reversed prefixes to its left are sorted:
   multikey quicksort over 8-byte words to a shallow depth, then blind tries
   for the groups with longer common prefixes. Both orders with their common
   prefix lengths tell for each string whether another one equals it.
   Cores with very many different surroundings, which one task should not
   hold, are settled by counting 128-bit hashes of their strings instead.
4. The intervals go back to their texts and are cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowloom.llm.common import batches_of, chunks, cut_lineage, given_back, map_batches, release, renamed, ship

WINDOW = 128
PIECE = 1 << 18  # bytes of text that a task looks for anchors in at once; a dozen arrays of 8 bytes for each of them
ROWS = 1000  # texts that a task gets at once
SHALLOW_WORDS = 2
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * M2
    return x ^ (x >> np.uint64(29))


def _words(buf: np.ndarray) -> np.ndarray:
    """The 8-byte word at every byte of ``buf`` (which has 8 spare bytes at its end)."""
    return np.ndarray(len(buf) - 7, "<u8", buf, 0, (1,))


def hash_ranges(buf: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of byte ranges; ``buf`` needs 8 spare bytes at its end."""
    words = _words(buf)
    h = _mix(length.astype(np.uint64) * M1 + np.uint64(seed))
    done = 0
    while done < (int(length.max()) if len(length) else 0):
        rest = length - done
        live = np.flatnonzero(rest > 0)
        w = words[start[live] + done]
        part = np.minimum(rest[live], 8).astype(np.uint64)
        w = np.where(part < 8, w & ((np.uint64(1) << (np.uint64(8) * (part % np.uint64(8)))) - np.uint64(1)), w)
        h[live] = _mix((h[live] + np.uint64(seed | 1)) * M1 ^ _mix(w + np.uint64(seed)))
        done += 8
    return h


def anchors(texts: list[bytes], length: int, window: int = WINDOW):
    """Anchors of all strings of ``length`` bytes in ``texts``.

    Returns the joined bytes with spare bytes, and per anchor: text number, its
    place, first and last start of its strings (places in the joined bytes),
    and the offset of each text.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.r_[0, np.cumsum(sizes)]
    # Spare bytes: the padding of the sliding minimum, and a word.
    buf = np.frombuffer(b"".join(texts) + bytes(2 * window + 8), np.uint8)
    n = int(offset[-1])
    h = _mix(_words(buf)[:n + 2 * window] * M1)
    place_bits = np.uint64(max(1, int(n + 2 * window).bit_length()))
    v = ((h >> place_bits) << place_bits) | np.arange(len(h), dtype=np.uint64)
    rows = len(v) // window
    block = v[:rows * window].reshape(rows, window)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    low = np.minimum(back[:n], ahead[window - 1:n + window - 1])
    at = (low & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    valid = np.arange(n) + length <= offset[text + 1]
    starts = np.flatnonzero(valid)
    if not len(starts):
        e = np.empty(0, np.int64)
        return buf, e, e, e, e, offset
    a, t = at[starts], text[starts]
    new = np.r_[True, (a[1:] != a[:-1]) | (t[1:] != t[:-1])]
    first = starts[new]
    last = starts[np.r_[new[1:], True]]
    return buf, t[new], a[new], first, last, offset


def _lcp(a: int, b: int, bits: int) -> int:
    """Common prefix bytes of two strings given as big-endian numbers of equal width."""
    x = a ^ b
    return (bits - x.bit_length()) >> 3


def blind_trie(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of equally long strings and the common prefix lengths of neighbours.

    Inner nodes hold a depth and branch on the byte there; the skipped bytes
    are not looked at on the way down. One comparison with the reached leaf
    gives the place of a new string. Equal strings share a leaf.
    """
    width = len(strings[0]) if strings else 0
    bits = 8 * width
    number = [int.from_bytes(s, "big") for s in strings]
    root: list | None = None  # node: [depth, {byte: node}] or leaf: [width, [indices]]
    for i, s in enumerate(strings):
        if root is None:
            root = [width, [i]]
            continue
        node = root
        while node[0] < width:
            children = node[1]
            node = children.get(s[node[0]]) or next(iter(children.values()))
        common = width if number[i] == number[node[1][0]] else _lcp(number[i], number[node[1][0]], bits)
        if common == width:
            node[1].append(i)
            continue
        other = strings[node[1][0]]
        parent, node = None, root
        while node[0] < common:
            parent, node = node, node[1][s[node[0]]]
        if node[0] == common:
            node[1][s[common]] = [width, [i]]
        else:
            split = [common, {other[common]: node, s[common]: [width, [i]]}]
            if parent is None:
                root = split
            else:
                parent[1][s[parent[0]]] = split
    order, shared, stack = [], [], [(root, 0)] if root else []
    while stack:
        node, left = stack.pop()
        if node[0] == width:
            for k, i in enumerate(node[1]):
                order.append(i)
                shared.append(left if k == 0 else width)
            continue
        keys = sorted(node[1], reverse=True)
        for k in keys:
            stack.append((node[1][k], left if k == keys[-1] else node[0]))
    return order, shared


def deep_shallow_sort(strings: np.ndarray, group: np.ndarray, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sort rows of bytes inside groups; returns order and common prefixes with
    the row before (-1 at the start of a group).

    ``strings`` is a (rows, width) byte array with width a multiple of 8; all
    rows of a group are known to share the first ``skip`` bytes (a multiple of 8).
    """
    rows, width = strings.shape
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.ascontiguousarray(strings).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    g = group[order]
    cls = np.cumsum(np.r_[True, g[1:] != g[:-1]]) - 1
    lcp = np.full(rows, -1, np.int64)
    fresh = np.r_[True, g[1:] != g[:-1]]
    depth = skip // 8
    # Multikey quicksort, one word at a time, of the groups that are still open.
    for _ in range(SHALLOW_WORDS):
        if depth >= width // 8:
            break
        size = np.bincount(cls)
        open_ = np.flatnonzero(size[cls] > 1)
        if not len(open_):
            break
        key = words[order[open_], depth]
        again = np.lexsort((key, cls[open_]))
        order[open_] = order[open_[again]]
        key = key[again]
        c = cls[open_]
        differs = np.r_[False, (key[1:] != key[:-1]) & (c[1:] == c[:-1])]
        where = open_[differs]
        x = key[1:][differs[1:]] ^ key[:-1][differs[1:]]
        lead = np.zeros(len(x), np.int64)
        for shift in range(56, 0, -8):
            lead += (x >> np.uint64(shift)) == 0
        lcp[where] = depth * 8 + lead
        fresh[where] = True
        cls = np.cumsum(fresh) - 1
        depth += 1
    # Groups with a longer common prefix go to blind tries.
    start = np.flatnonzero(fresh)
    for a, b in zip(start, np.r_[start[1:], rows]):
        if b - a > 1:
            members = order[a:b]
            tails = [strings[i, depth * 8:].tobytes() for i in members]
            sub, shared = blind_trie(tails)
            order[a:b] = members[sub]
            lcp[a + 1:b] = depth * 8 + np.array(shared[1:], np.int64)
    return order, lcp


def repeated_offsets(right: np.ndarray, left: np.ndarray, group: np.ndarray, low: np.ndarray, high: np.ndarray,
                     length: int, skip: int = 0) -> np.ndarray:
    """Which strings have an equal one in their group.

    Row i offers the strings that start ``low[i]`` to ``high[i]`` bytes before its
    anchor. Result: boolean (rows, window): [i, o] for the start o bytes before.
    """
    rows = len(group)
    window = int(high.max()) + 1 if rows else 0
    out = np.zeros((rows, window), bool)
    r_order, r_lcp = deep_shallow_sort(right, group, skip)
    l_order, l_lcp = deep_shallow_sort(left, group)
    r_id, l_id = np.empty(rows, np.int64), np.empty(rows, np.int64)
    for o in range(window):
        on = (low <= o) & (o <= high)
        if on.sum() < 2:
            continue
        r_id[r_order] = np.cumsum(r_lcp < length - o)
        l_id[l_order] = np.cumsum(l_lcp < o)
        pair = r_id[on] * (rows + 1) + l_id[on]
        _, inverse, count = np.unique(pair, return_inverse=True, return_counts=True)
        out[np.flatnonzero(on), o] = count[inverse] > 1
    return out


def merge_intervals(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _runs(flags: np.ndarray):
    """Rows, first and last columns of the runs of True in a boolean matrix."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return row, a, b - 1


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds the key of a row: its id (0 for none) and a hash of id and text.

    Rows that are equal in both share a key; they hold the same strings, so
    what is found for one holds for all of them."""
    return docs.withColumns({"_id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(0).cast("bigint")), "_row": F.xxhash64(id_col, text_col)})


def repeated_intervals(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text",
                       rows_per_task: int = 20_000, largest_group: int = 20_000) -> DataFrame:
    """Byte intervals [``a``, ``b``) of strings of ``length`` bytes that start more than once,
    by row: ``_id``, ``_row`` (see :func:`keyed`), ``a``, ``b``; they may overlap.

    The result is written; what led to it is deleted."""
    if length < WINDOW + 16:
        raise ValueError(f"strings of at least {WINDOW + 16} bytes")
    core = length - WINDOW + 1
    tail = -(-length // 8) * 8

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text", PIECE):
            texts = [(t or "").encode() for t in batch.column("_text").to_pylist()]
            buf, t, a, first, last, offset = anchors(texts, length)
            whole = last + length - first
            base, row = offset[t], pa.array(t)
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(row), batch.column("_row").take(row), pa.array(hash_ranges(buf, a, np.full(len(a), core), 1).view(np.int64)),
                pa.array((hash_ranges(buf, first, whole, 2) ^ _mix((a - first).astype(np.uint64) * M1)).view(np.int64)),
                pa.array((a - base).astype(np.int32)), pa.array((first - base).astype(np.int32)), pa.array((last - base).astype(np.int32)),
            ], ["_id", "_row", "core", "whole", "at", "first", "last"])

    slim = keyed(docs, id_col, text_col).select("_id", "_row", F.col(text_col).alias("_text"))
    with batches_of(docs.sparkSession, ROWS):
        found = cut_lineage(map_batches(slim, find, "_id bigint, _row bigint, core bigint, whole bigint, `at` int, first int, last int"))
    # Most cores occur once and have no partner: their anchors leave before wide rows are grouped. Each
    # statement's shuffle files go at its end, so the counts do not lie beside the anchors that are joined.
    often = cut_lineage(found.groupBy("core").count().where("count > 1").select("core"))
    every, found = found, cut_lineage(found.join(often, "core", "left_semi"))
    release(every, often)
    # Map-side combined counts: however many copies there are, one row a task.
    by_run = found.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_row", "at", "first", "last")).alias("one"))
    by_core = by_run.groupBy("core").agg(F.count("*").alias("kinds"))
    runs = cut_lineage(by_run.join(by_core, "core"))
    repeated = runs.where("n > 1").select("core", "whole")
    settled = found.join(repeated, ["core", "whole"]).selectExpr("_id", "_row", "first AS a", f"last + {length} AS b")
    # Runs that occur once, and one of each kind they may have strings in common with.
    open_runs = runs.where("kinds > 1").selectExpr("core", "kinds", "n = 1 AS ask", "one.*")
    around = _contexts(slim, open_runs, length)
    out = cut_lineage(settled.unionByName(_borders(around, length, core, tail, rows_per_task, largest_group)).distinct())
    release(found, runs, around)
    return out


def _contexts(slim: DataFrame, open_runs: DataFrame, length: int) -> DataFrame:
    """The bytes around the anchors of runs that are not settled by counts."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes around each anchor: reversed to its left, forward to its right."""
        for batch in chunks(batches, "_text"):
            out = {k: [] for k in ("_id", "_row", "core", "kinds", "ask", "at", "first", "last", "left", "right")}
            for i, row, text, asked in zip(batch.column("_id").to_pylist(), batch.column("_row").to_pylist(), batch.column("_text").to_pylist(), batch.column("asked").to_pylist()):
                data = (text or "").encode()
                for x in asked:
                    at, first, last = x["at"], x["first"], x["last"]
                    for k in ("core", "kinds", "ask", "at", "first", "last"):
                        out[k].append(x[k])
                    out["_id"].append(i)
                    out["_row"].append(row)
                    out["left"].append(data[first:at][::-1])
                    out["right"].append(data[at:last + length])
            if out["_row"]:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))

    asked = open_runs.groupBy("_id", "_row").agg(F.collect_list(F.struct("core", "kinds", "ask", "at", "first", "last")).alias("asked"))
    # A repeated row is read as often as it occurs; one of them serves.
    with batches_of(slim.sparkSession, ROWS):
        return cut_lineage(map_batches(
            slim.join(asked, ["_id", "_row"]), contexts,
            "_id bigint, _row bigint, core bigint, kinds bigint, ask boolean, `at` int, first int, last int, `left` binary, `right` binary"
        ).dropDuplicates(["_id", "_row", "core", "at"]))


def _borders(around: DataFrame, length: int, core: int, tail: int, rows_per_task: int, largest_group: int) -> DataFrame:
    """Repeated strings among runs of one core that differ as a whole."""
    ship(around.sparkSession)
    tasks = max(1, -(-around.count() // rows_per_task))

    def pad(values, width: int) -> np.ndarray:
        return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width)

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        at, first, last = (pdf[c].to_numpy().astype(np.int64) for c in ("at", "first", "last"))
        left_width = -(-WINDOW // 8) * 8
        dup = repeated_offsets(pad(pdf["right"], tail), pad(pdf["left"], left_width), pdf["core"].to_numpy(), at - last, at - first,
                               length, core // 8 * 8)
        row, o1, o2 = _runs(dup)
        keep = pdf["ask"].to_numpy()[row]
        row, o1, o2 = row[keep], o1[keep], o2[keep]
        return pd.DataFrame({"_id": pdf["_id"].to_numpy()[row], "_row": pdf["_row"].to_numpy()[row], "a": at[row] - o2, "b": at[row] - o1 + length})

    task = F.pmod(F.xxhash64("core"), F.lit(tasks)).cast("int")
    sorted_ = (
        around.where(F.col("kinds") <= largest_group).withColumn("_task", task).drop("kinds")
        .groupBy("_task").applyInPandas(sort, "_id bigint, _row bigint, a int, b int"))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                lefts, rights = part.column("left").to_pylist(), part.column("right").to_pylist()
                data = [x[::-1] + y for x, y in zip(lefts, rights)]
                base = np.r_[0, np.cumsum([len(d) for d in data])]
                buf = np.frombuffer(b"".join(data) + bytes(16), np.uint8)
                first, last = part.column("first").to_numpy(), part.column("last").to_numpy()
                many = last - first + 1
                which = np.repeat(np.arange(len(many)), many)
                inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                start = base[which] + inner
                size = np.full(len(start), length)
                yield pa.RecordBatch.from_arrays([
                    part.column("_id").take(pa.array(which)), part.column("_row").take(pa.array(which)), part.column("ask").take(pa.array(which)), pa.array((first[which] + inner).astype(np.int32)),
                    pa.array(hash_ranges(buf, start, size, 3).view(np.int64)), pa.array(hash_ranges(buf, start, size, 4).view(np.int64))],
                    ["_id", "_row", "ask", "a", "h1", "h2"])

    strings = map_batches(around.where(F.col("kinds") > largest_group).select("_id", "_row", "ask", "first", "last", "left", "right"), spell,
                          "_id bigint, _row bigint, ask boolean, a int, h1 bigint, h2 bigint")
    twice = strings.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    counted = strings.where("ask").join(twice, ["h1", "h2"]).selectExpr("_id", "_row", "a", f"a + {length} AS b")
    return sorted_.unionByName(counted)


def cut_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256``.

    Texts are UTF-8 bytes, NULL counts as empty and stays NULL as ``kept_text``
    where nothing is removed. Every byte inside a string of ``length`` bytes that
    also starts at another place of any row is removed; repeated rows are
    different rows, so they remove each other. ``kept_text`` drops the parts of a
    character that was cut through; the hash is of all kept bytes. A column of
    ``docs`` with the name of a result is replaced by it.
    """
    results = ["kept_text", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    rows, at = renamed(docs)
    intervals = repeated_intervals(docs, length, id_col, text_col, **options)
    by_row = intervals.groupBy("_id", "_row").agg(F.collect_list(F.struct("a", "b")).alias("_cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, at[text_col]):
            kept, n, gone, spans, sha = [], [], [], [], []
            for text, cuts in zip(batch.column(at[text_col]).to_pylist(), batch.column("_cut").to_pylist()):
                data = (text or "").encode()
                merged = merge_intervals([(c["a"], c["b"]) for c in cuts or []])
                end, parts = 0, []
                for a, b in merged:
                    parts.append(data[end:a])
                    end = b
                parts.append(data[end:])
                rest = b"".join(parts)
                n.append(len(data))
                gone.append(len(data) - len(rest))
                spans.append(len(merged))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(text if not merged else rest.decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in at.values()], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(sha, pa.string())], [*at.values(), *results])

    joined = keyed(rows, at[id_col], at[text_col]).join(by_row, ["_id", "_row"], "left")
    kinds = (T.StringType(), T.LongType(), T.LongType(), T.LongType(), T.StringType())
    done = map_batches(joined, cut, T.StructType([*rows.schema, *map(T.StructField, results, kinds)]))
    return done.select(*given_back(at, results), *results)
