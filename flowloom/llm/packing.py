"""Tokenise documents and pack them into sequences by vector best fit.

A sequence has three capacities: tokens, number of pieces, and attention cost
(the sum of squared piece lengths). A piece may enter a sequence only if all
three residuals allow it. Among those that allow it, the *dot* rule takes the
largest weighted dot product of demand and residual, the *norm* rule the
smallest weighted norm of what would remain. Pieces come in decreasing length.

Documents are dealt by a hash of their id into shards whose number follows the
data, so shards are alike in size, no key gathers rows, and each shard leaves
at most about one sequence poorly filled.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowloom.llm.common import chunks, cut_lineage, map_batches, ship
from flowloom.llm.pieces import tokenizer_path
from flowloom.llm.words import byte_table, flat_words

KNOWN_TOKENS = 900_000
KEPT_LENGTH = 40
CHUNK = 1 << 22


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds. The defaults for pieces and attention are the
    largest values that a full sequence can reach, so only tokens bind."""

    tokens: int = 2048
    pieces: int = 2048
    attention: int = 2048 * 2048


class WordIds:
    """Ids of whole texts, put together from those of their space-separated parts.

    The vocabulary drops white space before it merges, so no token crosses it; nor does
    one hold a letter and the mark that ends its part, so such marks are parts of their own.
    A chunk's parts are numbered by Arrow; only its different ones are looked
    up, and the library encodes each once per task (a bounded table).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.comma = self.tokenizer.encode(",", add_special_tokens=False).ids
        # The vocabulary is lower case. Special ids are spelt in lower case as
        # well, so texts with such brackets keep their letters.
        self.folding, self.plain = byte_table(b" \n", fold=True), byte_table(b" \n")
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}  # places in `ids`
        self.ids = pa.array([], pa.large_binary())

    def each(self, words: list[bytes]) -> pa.Array:
        """Ids (as bytes) of words without white space."""
        held = np.array([b"," in w for w in words], bool)
        order = np.argsort(held, kind="stable")
        clean = [words[i] for i in order[:len(words) - int(held.sum())].tolist()]
        single, sizes, flat = [words[i] for i in order[len(clean):].tolist()], [], []
        for at in range(0, len(clean), 20_000):
            # Some 250 words in one call, and a comma behind each, which marks their ends.
            some = clean[at:at + 20_000]
            lines = [b" , ".join([*some[i:i + 250], b""]).decode("utf-8", "replace") for i in range(0, len(some), 250)]
            ids = np.concatenate([np.frombuffer(array("I", e.ids), np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
            mark = ids == self.comma[0]
            if len(self.comma) > 1 or mark.sum() != len(some):
                single = clean[at:] + single
                break
            ends = np.flatnonzero(mark)
            sizes.append(np.diff(ends, prepend=-1) - 1)
            flat.append(ids[~mark])
        for at in range(0, len(single), 20_000):
            some = [w.decode("utf-8", "replace") for w in single[at:at + 20_000]]
            ids = [array("I", e.ids) for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            sizes.append(np.array([len(i) for i in ids], np.int64))
            flat.append(np.frombuffer(b"".join(ids), np.uint32))
        offsets = np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes])) * 4
        body = pa.py_buffer(np.concatenate([np.empty(0, np.uint32), *flat]))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), body]).take(pa.array(np.argsort(order)))

    def of_parts(self, parts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Ids (as bytes) of many words, and the place there of each of ``parts``, which are different."""
        if len(self.known) + len(parts) > KNOWN_TOKENS:
            self.forget()
        place = np.fromiter((self.known.get(w, -1) for w in parts), np.int64, len(parts))
        missing = np.flatnonzero(place < 0)
        new = [parts[i] for i in missing.tolist()]
        if not new:
            return self.ids, place
        long = np.array([len(w) > KEPT_LENGTH for w in new], bool)
        order = np.argsort(long, kind="stable")
        place[missing[order]] = len(self.ids) + np.arange(len(new))
        new = [new[i] for i in order.tolist()]
        kept = len(new) - int(long.sum())
        self.known.update(zip(new[:kept], range(len(self.ids), len(self.ids) + kept)))
        ids = pa.concat_arrays([self.ids, self.each(new)])
        self.ids = pa.concat_arrays([ids.slice(0, len(self.known))])
        return ids, place

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every row of a binary column."""
        out = []
        special = np.r_[pc.match_substring(texts, "<|").fill_null(False).to_numpy(zero_copy_only=False)]
        cuts = np.r_[0, np.flatnonzero(np.diff(special)) + 1, len(special)]
        for at, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end > at:
                words = flat_words(texts.slice(at, end - at), self.plain if special[at] else self.folding, apart=b".,")
                ids, place = self.of_parts(words.names.to_pylist())
                taken = ids.take(pa.array(place[words.code]))
                edges = np.frombuffer(taken.buffers()[1], np.int64)[np.r_[0, np.cumsum(words.count)] + taken.offset] // 4
                flat = np.frombuffer(taken.buffers()[2] or b"", np.uint32)
                out += [flat[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
    return WordIds(path)


def pieces(docs: DataFrame, size: int, tokenizer: str = "word_bpe_49k.json", end_id: int = 0,
           id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token ids of every document and the end id, cut every ``size`` ids.

    One row per piece: ``id_col``, ``piece``, ``start``, ``length``,
    ``ids_crc32`` and, with ``with_ids``, ``ids``. A NULL or empty text is the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer if "/" in tokenizer else tokenizer_path(tokenizer))
        for batch in chunks(batches, "_text", CHUNK):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, body in enumerate(words.encode(batch.column("_text"))):
                all_ids = np.append(body, np.uint32(end_id)).astype("<u4")
                for k, at in enumerate(range(0, len(all_ids), size)):
                    part = all_ids[at:at + size]
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part)
            columns = [batch.column("_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
        words.forget()  # over 100 MB that the worker would keep through later stages

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS _text"), run,
        f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    ).withColumnRenamed("_id", id_col)


def vector_best_fit(lengths: np.ndarray, capacity: Capacity, rule: str = "norm",
                    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)) -> np.ndarray:
    """The bin number of every piece; lengths must be at most the token capacity.

    Pieces are taken in decreasing length, ties in the given order; equal
    scores go to the earliest bin. A bin that no remaining piece can enter is
    closed, so the search runs over open bins only.
    """
    size = np.array([capacity.tokens, capacity.pieces, capacity.attention], float)
    w = np.array(weights)
    out = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    if not len(order):
        return out
    smallest = int(lengths.min())
    room = 64
    left, name, used, bins = np.empty((room, 3)), np.empty(room, np.int64), 0, 0
    for i in order.tolist():
        n = float(lengths[i])
        need = np.array([n, 1.0, n * n])
        best = -1
        if used and n < capacity.tokens:
            residual = left[:used]
            fits = np.flatnonzero((residual[:, 0] >= n) & (residual[:, 1] >= 1) & (residual[:, 2] >= n * n))
            if len(fits):
                open_ = residual[fits] / size
                if rule == "dot":
                    score = -(open_ @ (w * need / size))
                else:
                    rest = open_ - need / size
                    score = (rest * rest) @ w
                best = int(fits[np.argmin(score)])
        if best < 0:
            if n * n > capacity.attention:
                raise ValueError("a piece exceeds the attention capacity of an empty sequence")
            if used == room:
                left, name, room = np.concatenate([left, np.empty_like(left)]), np.concatenate([name, np.empty_like(name)]), room * 2
            best, used = used, used + 1
            left[best], name[best] = size, bins
            bins += 1
        left[best] -= need
        out[i] = name[best]
        if left[best, 0] < smallest or left[best, 1] < 1 or left[best, 2] < smallest * smallest:
            used -= 1
            left[best:used], name[best:used] = left[best + 1:used + 1].copy(), name[best + 1:used + 1].copy()
    return out


def pack(parts: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", id_col: str = "doc_id",
         shard_rows: int = 8192, total: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of :func:`pieces`.

    ``total`` is the number of rows (counted if not given); ``shard_rows`` rows
    are packed together on average. Every row is placed. Repeated ids are
    different rows. Pieces as long as a sequence are packed without a search.
    """
    ship(parts.sparkSession)
    total = parts.count() if total is None else total
    shards = max(1, -(-total // shard_rows))
    fields = parts.schema

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([id_col, "piece", "ids_crc32"], kind="stable", ignore_index=True)
        shard = int(pdf["_shard"].iloc[0])
        lengths = pdf["length"].to_numpy()
        placed = vector_best_fit(lengths, capacity, rule)
        order = np.argsort(placed, kind="stable")
        run_length = lengths[order]
        before = np.cumsum(run_length) - run_length
        first = np.r_[True, placed[order][1:] != placed[order][:-1]]
        offset = np.empty(len(pdf), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        pdf["sequence_id"], pdf["offset"] = shard * (1 << 32) + placed, offset
        return pdf.drop(columns="_shard")

    shard = F.pmod(F.xxhash64(id_col, "piece"), F.lit(shards)).cast("int")
    return parts.withColumn("_shard", shard).groupBy("_shard").applyInPandas(
        run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id bigint, `offset` bigint")


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), rule: str = "norm", **columns) -> DataFrame:
    """Tokenise and pack; one row per piece. Pieces are written once between the
    two steps, so a lost executor does not cost the tokenising of other shards.

    NULL and empty texts give the end id alone; an empty table gives no rows;
    repeated rows are packed as often as they occur; other columns are ignored.
    """
    parts = cut_lineage(pieces(docs, capacity.tokens, **columns))
    return pack(parts, capacity, rule, columns.get("id_col", "doc_id"))
