"""Ranked lexical search by dense blocked multiplication.

Queries come in groups whose distinct terms are bounded, so what is broadcast
is bounded; a larger query set means more groups and more passes over the
documents. For a group, one pass turns every whole text into its numbers of the
group's terms (a table of term numbers and counts), statistics come from that
table, and a second pass multiplies: a tile of query weights (queries x terms)
by a tile of document impacts (terms x documents), both dense float64. Weights
and impacts are integers. A tile is cut so that no query's partial sum can reach
2^53, so every product is exact, and the partial sums of the tiles are added as
64-bit integers. A tile's k best keep everything that ties with the k-th score
before ids decide. No document moves: tasks return k rows per query, merged in
two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.llm.common import chunks, cut_lineage, map_batches
from flowloom.llm.words import byte_table, flat_words

# ASCII characters that are neither digits nor letters separate terms.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SCALE = 1_000_000_000
MOST_IMPACT = 1_000_000  # an impact is below SCALE / 1000
EXACT = 1 << 53
QUERY_TILE, TERM_TILE, DOC_TILE = 256, 4096, 1024


def bags(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``terms`` and ``times`` (how often) of each whole text."""
    table = byte_table(SEPARATORS, fold=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            words = flat_words(batch.column("_text"), table)
            width = max(1, len(words.names))
            keys, times = np.unique(words.row * width + words.code, return_counts=True)
            edges = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * width), pa.int32())
            names = words.names.take(pa.array(keys % width)).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.ListArray.from_arrays(edges, names), pa.ListArray.from_arrays(edges, pa.array(times, pa.int64()))],
                ["_id", "terms", "times"])

    kind = rows.schema[id_col].dataType.simpleString()
    return map_batches(rows.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS _text"), run,
                       f"_id {kind}, terms array<binary>, times array<bigint>")


def counted(docs: DataFrame, vocabulary, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``n`` (all terms) and the ``term`` numbers in ``vocabulary`` (a broadcast
    dictionary) with their ``tf`` of every whole text."""
    table = byte_table(SEPARATORS, fold=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in chunks(batches, "_text"):
            words = flat_words(batch.column("_text"), table)
            known = np.array([number.get(t, -1) for t in words.names.to_pylist()], np.int64)
            term = known[words.code] if len(known) else np.zeros(0, np.int64)
            kept = term >= 0
            keys, tf = np.unique(words.row[kept] * len(number) + term[kept], return_counts=True)
            edges = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) * len(number)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(words.count, pa.int64()),
                 pa.ListArray.from_arrays(edges, pa.array(keys % len(number), pa.int32())), pa.ListArray.from_arrays(edges, pa.array(tf, pa.int64()))],
                ["_id", "n", "term", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.selectExpr(f"`{id_col}` AS _id", f"CAST(`{text_col}` AS BINARY) AS _text"), run,
                       f"_id {kind}, n bigint, term array<int>, tf array<bigint>")


def holders(postings: DataFrame, width: int) -> np.ndarray:
    """In how many documents each of ``width`` terms occurs; added up per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("term").flatten().to_numpy(), minlength=width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["term", "df"])

    out = np.zeros(width, np.int64)
    sums = map_batches(postings.select("term"), run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for batch in sums.toArrow().to_batches():
        out[batch.column("term").to_numpy()] = batch.column("df").to_numpy()
    return out


def tiles(query: np.ndarray, term: np.ndarray, weight: np.ndarray, limit: int = EXACT // MOST_IMPACT) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, terms, weights as queries x terms) of all tiles.

    No row of weights adds up to more than ``limit``. A weight above half of it
    is cut into parts, which come to lie in different tiles.
    """
    half = max(1, limit // 2)
    parts = np.maximum(1, -(-weight // half))
    query, term = np.repeat(query, parts), np.repeat(term, parts)
    within = np.arange(len(query)) - np.repeat(np.cumsum(parts) - parts, parts)
    weight = np.minimum(half, np.repeat(weight, parts) - within * half)
    order = np.lexsort((term, query))
    query, term, weight = query[order], term[order], weight[order]
    before = np.cumsum(weight) - weight
    first = np.searchsorted(query, query)  # where each entry's query begins
    level = (before - before[first]) // half if len(query) else before
    # Two parts of one weight are half apart, hence on different levels.
    out = []
    for block in np.unique(query // QUERY_TILE).tolist():
        for depth in np.unique(level[query // QUERY_TILE == block]).tolist():
            here = (query // QUERY_TILE == block) & (level == depth)
            names = np.unique(term[here])
            for at in range(0, len(names), TERM_TILE):
                own = names[at:at + TERM_TILE]
                inside = here & (term >= own[0]) & (term <= own[-1])
                matrix = np.zeros((int(query[inside].max()) - block * QUERY_TILE + 1, len(own)))
                np.add.at(matrix, (query[inside] - block * QUERY_TILE, np.searchsorted(own, term[inside])), weight[inside])
                out.append((block * QUERY_TILE, own, matrix))
    return out


class Best:
    """The k highest positive scores of every query so far; ties go to the smaller id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.id: list[np.ndarray] = [np.zeros(0, np.int64)] * queries
        self.worst = np.ones(queries, np.int64)

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries from ``first`` on, by document."""
        worst = self.worst[first:first + len(scores)]
        for i in np.flatnonzero((scores >= worst[:, None]).any(axis=1)).tolist():
            row = scores[i]
            good = np.flatnonzero(row >= worst[i])
            if len(good) > self.k:
                limit = np.partition(row[good], len(good) - self.k)[len(good) - self.k]
                good = good[row[good] >= limit]
            q = first + i
            score, doc = np.r_[self.score[q], row[good]], np.r_[self.id[q], ids[good]]
            order = np.lexsort((doc, -score))[:self.k]
            self.score[q], self.id[q] = score[order], doc[order]
            if len(order) == self.k:
                self.worst[q] = score[order[-1]]


def search(postings: DataFrame, work, k: int) -> DataFrame:
    """``query`` (number in the group), ``doc``, ``score``: k rows per query and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, queries, documents, words = work.value
        width = max((int(names[-1]) + 1 for _, names, _ in made), default=0)
        best = Best(queries, k)
        for batch in batches:
            for at in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(at, DOC_TILE)
                sizes = part.column("term").value_lengths().to_numpy()
                term, tf = part.column("term").flatten().to_numpy().astype(np.int64), part.column("tf").flatten().to_numpy()
                ids = part.column("_id").to_numpy()
                length = np.array([25 + 75 * n * documents // words for n in part.column("n").to_pylist()], np.int64)
                doc = np.repeat(np.arange(part.num_rows), sizes)
                impact = (SCALE * tf) // (1000 * tf + 8 * length[doc])
                sums: dict[int, np.ndarray] = {}
                for first, names, weights in made:
                    column = np.full(max(width, int(term.max(initial=0)) + 1), -1, np.int64)
                    column[names] = np.arange(len(names))
                    place = column[term]
                    own = place >= 0
                    if not own.any():
                        continue
                    dense = np.zeros((len(names), part.num_rows))
                    dense[place[own], doc[own]] = impact[own]
                    product = (weights @ dense).astype(np.int64)
                    if first in sums:
                        if len(product) > len(sums[first]):
                            sums[first], product = product, sums[first]
                        sums[first][:len(product)] += product
                    else:
                        sums[first] = product
                for first, scores in sums.items():
                    best.add(first, scores, ids)
        count = [len(s) for s in best.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(queries), count), pa.int32()), pa.array(np.concatenate([*best.id, np.zeros(0, np.int64)]), pa.int64()),
             pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)]), pa.int64())], ["query", "doc", "score"])

    return map_batches(postings, run, "query int, doc bigint, score bigint")


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
                   id_col: str = "doc_id", text_col: str = "text", group_terms: int = 1_000_000, group_bytes: int = 1 << 26) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id``, ``score`` of the k best documents per item.

    Terms are what ASCII characters other than digits and letters separate, with
    only A-Z lowered. ``group_terms`` distinct terms per item, summed, and
    ``group_bytes`` of them bound a group on average; one item is never cut.
    NULL, empty and termless texts match nothing; all texts count in the
    statistics, also those with a NULL id, which are never returned. Repeated
    documents each have a place; equal items (same id and text) count once, and
    different texts under one id are ranked each for itself. Other columns are
    ignored. Document ids are integers. An empty side gives no rows.
    """
    spark = docs.sparkSession
    queries = cut_lineage(bags(items.select(item_id, item_text).distinct(), item_id, item_text).where("size(terms) > 0"))
    size = queries.agg(F.sum(F.size("terms")).alias("t"), F.sum(F.expr("aggregate(terms, 0L, (a, x) -> a + octet_length(x))")).alias("b")).first()
    groups = max(1, -(-(size.t or 0) // group_terms), -(-(size.b or 0) // group_bytes))
    result = None
    for g in range(groups):
        own = queries.where(F.pmod(F.xxhash64("_id", "terms"), F.lit(groups)) == g).toArrow().to_pylist()  # bounded by the group
        names = sorted({t for q in own for t in q["terms"]})
        number = {t: i for i, t in enumerate(names)}
        if not names:
            continue
        vocabulary = spark.sparkContext.broadcast(number)
        postings = cut_lineage(counted(docs, vocabulary, id_col, text_col))
        total = postings.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("words")).first()
        if not total.documents:
            continue
        df = holders(postings, len(names))
        weight = [math.floor(1000 * math.log((2 * total.documents + 2) / (2 * d + 1))) for d in df.tolist()]
        entries = [(i, number[t], c * weight[number[t]]) for i, q in enumerate(own) for t, c in zip(q["terms"], q["times"])]
        made = tiles(*(np.array(x, np.int64) for x in zip(*entries)))
        work = spark.sparkContext.broadcast((made, len(own), total.documents, total.words))
        found = search(postings.where("_id IS NOT NULL AND size(term) > 0").withColumn("_id", F.col("_id").cast("bigint")), work, k)
        label = spark.createDataFrame([(i, q["_id"]) for i, q in enumerate(own)], f"query int, `{item_id}` {items.schema[item_id].dataType.simpleString()}")
        part = merged(found, k).join(F.broadcast(label), "query")  # one row per item of the group
        part = part.select(item_id, "rank", F.col("doc").alias(id_col), "score")
        result = part if result is None else result.unionByName(part)
    if result is None:
        kind = items.schema[item_id].dataType.simpleString()
        return spark.createDataFrame([], f"`{item_id}` {kind}, `rank` int, `{id_col}` bigint, score bigint")
    return result


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best rows per query, first within shares of the documents, so that no
    task sees more rows of a query than k per share and task."""
    share = F.pmod(F.xxhash64("doc"), F.lit(64))
    order = [F.desc("score"), F.asc("doc")]
    once = found.withColumn("_r", F.row_number().over(Window.partitionBy("query", share).orderBy(*order))).where(F.col("_r") <= k)
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
lengths AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, total GROUP BY term),
scores AS (SELECT q.item_id, p.doc_id,
        sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words))))::BIGINT AS score
    FROM q JOIN weights USING (term) JOIN postings p USING (term) JOIN lengths l ON l.doc_id = p.doc_id, total
    GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
