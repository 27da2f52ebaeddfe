"""Quality by an interpolated modified Kneser-Ney model over text symbols.

Texts are folded to an alphabet of ``A`` symbols: the ``OWN`` most frequent
characters of the trusted text, counted over all of it, and five classes for
the rest. No character is lost in its class: its own probability there, from
the counts of all characters of the trusted text, is the second factor of its
probability (a class-based n-gram model), and texts are judged by both.
Counts of symbol n-grams
over all trusted text are added up inside each task, then shuffled by n-gram
(every shard holds the sums of its own n-grams), and joined shard by shard with
the sums of their contexts to give discounted probabilities and back-off
weights. The alphabet bounds these tables (at most A**ORDER rows, a few MB as
an array), so they are sent to all tasks, and scoring reads every document once
without a shuffle. What is gathered grows with the tasks that count.

Those classes lose what a character says about the next one, so they do not decide. Documents are judged by
a model over the characters themselves (:mod:`ngrams`), in which every character is a symbol and
a context of its own, however many there are.

A document's perplexity by that model is compared with a quantile of the trusted documents of
its language, each of them measured by a model that has not seen it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from flowloom.functions.ordered import small_side
from flowloom.llm import ngrams
from flowloom.llm.common import batches_of, chunks, cut_lineage, given_back, map_batches, release, renamed

ORDER = 4
ROWS = 1000  # texts that a task gets at once
LEAST = np.float32(1e-7)
DISCOUNT = 0.5  # of a character's count within its class
# Characters with a symbol of their own. White space, digits, capitals, other
# letters and everything else are one symbol each; a capital that is frequent
# enough has its own as well.
OWN = 37
SPACE, DIGIT, CAPITAL, LETTER, OTHER = (OWN + i for i in range(5))
A = OWN + 5


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        s = chr(c)
        if s.isspace():
            out[c] = SPACE
        elif s.isdigit():
            out[c] = DIGIT
        elif s.isupper():
            out[c] = CAPITAL
        elif s.isalpha():
            out[c] = LETTER
    return out


@lru_cache(maxsize=4)
def _fold_table(own: str) -> np.ndarray:
    """Symbol of every code point, with the characters of ``own`` numbered from 0."""
    out = _classes().copy()
    for i, c in enumerate(own):
        out[ord(c)] = i
    return out


def points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def characters(texts: DataFrame, text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Code points that occur in all texts, ascending, and their counts; as many rows as there are different characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in chunks(batches, "_text"):
            seen = np.bincount(points([t or "" for t in batch.column("_text").to_pylist()]))
            total[:len(seen)] += seen
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["c", "n"])

    counted = map_batches(texts.selectExpr(f"`{text_col}` AS _text"), run, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    rows = counted.toPandas().sort_values("c")
    return rows["c"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def most_frequent(at: np.ndarray, n: np.ndarray) -> str:
    """The ``OWN`` most frequent characters, white space and digits left out, ties by code point."""
    letters = ~np.isin(_classes()[at], (SPACE, DIGIT))
    at, n = at[letters], n[letters]
    return "".join(map(chr, at[np.lexsort((at, -n))[:OWN]]))


def alphabet(texts: DataFrame, text_col: str = "text") -> str:
    return most_frequent(*characters(texts, text_col))


def within_class(own: str, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Natural log probability of every code point given its symbol: 0 for a character with
    a symbol of its own, else its count less ``DISCOUNT`` over the count of the class, and what
    is taken off is dealt evenly over all code points of the class, seen or not."""
    symbol = _fold_table(own)
    size = np.bincount(symbol, minlength=A).astype(float)
    total = np.bincount(symbol[at], n, minlength=A)
    seen = np.bincount(symbol[at], minlength=A)
    free = np.where(total > 0, DISCOUNT * seen / np.maximum(total, 1), 1.0) / np.maximum(size, 1)
    p = free[symbol]
    p[at] += ((n - DISCOUNT) / total[symbol[at]])
    p[symbol < OWN] = 1.0
    return np.log(p).astype(np.float32)


def grams(texts: list[str | None], own: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of order ``ORDER`` that end at each symbol, and symbols per text.

    Every text is preceded by ``ORDER - 1`` spaces, so each symbol has a context
    and no n-gram crosses texts.
    """
    pad = " " * (ORDER - 1)
    n = np.array([len(t or "") for t in texts], np.int64)
    symbols = _fold_table(own)[points([pad + (t or "") for t in texts])].astype(np.int32)
    code = np.zeros(max(0, len(symbols) - ORDER + 1), np.int32)
    for k in range(ORDER):
        code = code * A + symbols[k:len(symbols) - ORDER + 1 + k]
    # The n-gram that ends at symbol i starts at i - ORDER + 1.
    keep = np.ones(len(symbols), bool)
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    for k in range(ORDER - 1):
        keep[starts + k] = False
    return code[keep[ORDER - 1:]], n


def count_grams(texts: DataFrame, own: str, text_col: str = "text") -> DataFrame:
    """``gram`` and ``n`` of order ``ORDER`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(A ** ORDER, np.int64)  # 30 MB
        for batch in chunks(batches, "_text"):
            code, _ = grams(batch.column("_text").to_pylist(), own)
            seen, n = np.unique(code, return_counts=True)
            total[seen] += n
        seen = np.flatnonzero(total)
        for k in range(0, len(seen), 100_000):
            part = seen[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["gram", "n"])

    return map_batches(texts.selectExpr(f"`{text_col}` AS _text"), run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of one order from its counts of counts (Chen and Goodman)."""
    n = {r["n"]: r["m"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("m")).collect()}
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
    ratio = lambda k, a, b: min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 * k
    return [ratio(1, n1, n2), ratio(2, n2, n3), ratio(3, n3, n4)]


def train(trusted: DataFrame, text_col: str = "text") -> tuple[str, list[tuple[np.ndarray, ...]], tuple[np.ndarray, np.ndarray]]:
    """The alphabet, for each order (gram, discounted probability, context, back-off weight),
    and the characters with their counts.

    Orders below the highest count distinct left neighbours. All text of
    ``trusted`` is used. An empty table gives a model of equal probabilities.
    """
    with batches_of(trusted.sparkSession, ROWS):
        counted = characters(trusted, text_col)
        own = most_frequent(*counted)
        level = cut_lineage(count_grams(trusted, own, text_col))
    model = []
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = _discounts(level)
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        contexts = level.groupBy(F.expr(f"gram div {A}").alias("context")).agg(
            F.sum("n").alias("total"), F.sum(discount).alias("freed"))
        joined = level.withColumn("context", F.expr(f"gram div {A}")).join(contexts, "context")
        rows = joined.select("gram", ((F.col("n") - discount) / F.col("total")).cast("float").alias("p")).toPandas()
        weights = contexts.select("context", (F.col("freed") / F.col("total")).cast("float").alias("w")).toPandas()
        model.append(tuple(np.ascontiguousarray(x) for x in (
            rows["gram"].to_numpy(np.int32), rows["p"].to_numpy(np.float32), weights["context"].to_numpy(np.int32), weights["w"].to_numpy(np.float32))))
        if order > 1:
            above = level
            level = cut_lineage(above.groupBy(F.expr(f"gram % {A ** (order - 1)}").alias("gram")).agg(F.count("*").alias("n")))
            release(above)
    return own, model[::-1], counted


def log_table(model) -> np.ndarray:
    """Natural log probability of the last symbol of every n-gram of order ``ORDER``."""
    lower = np.full(1, 1 / A, np.float32)
    for order, (gram, p, context, w) in enumerate(model, 1):
        weight = np.ones(A ** (order - 1), np.float32)
        weight[context] = w
        # The lower order lacks the first symbol: it repeats for each of them.
        now = np.full(A, lower[0]) if order == 1 else np.tile(lower, A)
        now.reshape(-1, A)[:] *= weight[:, None]
        now[gram] += p
        lower = now
    # Small training texts can leave a probability of 0; its logarithm must stay finite.
    return np.log(np.maximum(lower, LEAST), out=lower)


def score(docs: DataFrame, model, text_col: str = "text", tables=None) -> DataFrame:
    """``docs`` with ``n_symbols``, ``log_prob`` of its symbols and ``log_rest`` of its characters
    given their symbols of every row; NULL text counts as empty. With ``tables`` of a model over
    characters (:func:`ngrams.gather`), ``log_text`` as well."""
    own, orders, counted = model
    # At most ORDER * A**ORDER entries, and one for each different character.
    sent = docs.sparkSession.sparkContext.broadcast((orders, counted, tables))
    names = ["n_symbols", "log_prob", "log_rest"] + ["log_text"] * (tables is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders, counted, tables = sent.value
        table, rest = log_table(orders), within_class(own, *counted)
        number = None if tables is None else ngrams.numbers(counted[0])
        for batch in chunks(batches, text_col):
            texts = batch.column(text_col).to_pylist()
            code, n = grams(texts, own)
            end = np.cumsum(n)
            sums = []
            for logs in (table[code], rest[points([t or "" for t in texts])]):
                total = np.r_[0.0, np.cumsum(logs, dtype=np.float64)]
                sums.append(pa.array(total[end] - total[end - n]))
            if tables is not None:
                sums.append(pa.array(ngrams.sums(texts, number, tables)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n), *sums], [*batch.schema.names, *names])

    kinds = [T.LongType()] + [T.DoubleType()] * (len(names) - 1)
    return map_batches(docs, run, T.StructType([*docs.schema, *map(T.StructField, names, kinds)]))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.995, prior_symbols: float = 100.0, slack: float = 1.1,
          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with ``n_symbols``, ``perplexity``, ``char_perplexity``, ``text_perplexity``, ``adjusted``, ``threshold`` and ``kept``.

    Trusted documents are those with ``quality`` 1 in ``labels``; all of them
    train the model. ``perplexity`` is that of the symbols, ``char_perplexity`` that of the
    characters given their classes, ``text_perplexity`` that of a model over all characters; they are per symbol
    and NULL for an empty text.
    ``adjusted`` draws the last of short texts towards the mean of their language by
    ``prior_symbols`` symbols. A row is kept if ``adjusted`` is at most the
    language's ``quantile`` over trusted documents times ``slack``, where each of them is measured by the model
    of the other half of the texts (by that of all if its language has texts in one half only); languages
    without trusted documents use that of all; without any nothing is rejected.
    Empty texts are rejected, as there is nothing in them; repeated rows and
    rows with a NULL id are judged by their text; a NULL language is one of its own.
    A column of ``docs`` with the name of a result is replaced by it.
    """
    # Broadcast only after its rows were counted; otherwise joined by shuffle.
    trusted_ids = small_side(labels.where("quality = 1").select(F.col("doc_id").alias(id_col)).distinct())
    trusted = docs.select(id_col, text_col, lang_col).join(trusted_ids, id_col, "left_semi")
    model = train(trusted.select(id_col, text_col), text_col)
    known = model[2][0]
    texts = trusted.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"))
    texts = texts.where("_text <> ''").withColumn("_fold", ngrams.fold("_text"))
    full = ngrams.train(texts, known)
    rows, at = renamed(docs)
    of = ngrams.parts(full)
    if of == 1:
        scored = score(rows, model, at[text_col], ngrams.gather(full, ngrams.ALL))
    else:
        whole = score(rows, model, at[text_col]).withColumn("_model", F.lit(ngrams.ALL))
        scored = ngrams.score(whole, full, known, at[text_col], "_model", "log_text").drop("_model")
    lang = F.coalesce(at[lang_col], F.lit(""))
    scored = scored.withColumnRenamed("log_text", "_log")
    with batches_of(docs.sparkSession, ROWS):
        # A language whose texts are all in one half is unknown to the model of the other.
        halves = small_side(texts.groupBy("_lang").agg((F.count_distinct("_fold") == ngrams.FOLDS).alias("_halved")))
        measured_by = F.when(F.col("_halved"), F.col("_fold")).otherwise(ngrams.ALL)
        apart = ngrams.score(texts.join(halves, "_lang").withColumn("_model", measured_by).select("_lang", "_text", "_model"), full, known, "_text", "_model", "_log")
        seen = cut_lineage(apart.select("_lang", F.length("_text").cast("long").alias("n_symbols"), "_log"))
    mean = F.sum("_log") / F.sum("n_symbols")
    means = seen.groupBy("_lang").agg(mean.alias("_mean"))
    total = seen.agg(mean.alias("_all_mean"))  # one row

    def adjusted():
        average = F.coalesce("_mean", "_all_mean", F.lit(0.0))
        return F.exp(-(F.col("_log") + prior_symbols * average) / (F.col("n_symbols") + prior_symbols))

    quant = F.percentile_approx("adjusted", quantile, 10_000)
    measured = seen.join(means, "_lang").crossJoin(F.broadcast(total)).withColumn("adjusted", adjusted())
    limits = small_side(means.join(measured.groupBy("_lang").agg(quant.alias("_limit")), "_lang"))
    overall = cut_lineage(total.crossJoin(F.broadcast(measured.agg(quant.alias("_limit_all")))))
    out = scored.withColumn("_lang", lang).join(limits, "_lang", "left").crossJoin(F.broadcast(overall)).withColumn("adjusted", adjusted())
    limit = F.coalesce("_limit", "_limit_all") * slack
    return out.select(
        *given_back(at, ["n_symbols", "perplexity", "char_perplexity", "text_perplexity", "adjusted", "threshold", "kept"]), "n_symbols",
        F.when(F.col("n_symbols") > 0, F.exp(-F.col("log_prob") / F.col("n_symbols"))).alias("perplexity"),
        F.when(F.col("n_symbols") > 0, F.exp(-(F.col("log_prob") + F.col("log_rest")) / F.col("n_symbols"))).alias("char_perplexity"),
        F.when(F.col("n_symbols") > 0, F.exp(-F.col("_log") / F.col("n_symbols"))).alias("text_perplexity"),
        "adjusted", limit.alias("threshold"),
        ((F.col("n_symbols") > 0) & (limit.isNull() | (F.col("adjusted") <= limit))).alias("kept"))
