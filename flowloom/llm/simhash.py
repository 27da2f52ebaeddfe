"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance at most 2r have a value at distance at most r from
both. So every distinct fingerprint emits all values within r = 1 of itself (65
of them), values are shuffled, and fingerprints that meet on a value are linked
after a check of their distance. At most 65 fingerprints lie around a value, so
no group is large, however many documents share a fingerprint: equal
fingerprints are one row before anything is emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.ordered import small_side
from flowloom.llm.common import batches_of, chunks, components, cut_lineage, free_name, map_batches, release

SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash over word shingles, repeats included; 0 without words."""
    import xxhash

    # bytes.lower() and bytes.split() act on A-Z and on ASCII white space only.
    tokens = (text or "").encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at:at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``fp`` (signed 64 bit) of every row; NULL text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            fp = np.array([fingerprint(t, words) for t in batch.column("_text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(fp)], ["_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.selectExpr(f"`{id_col}` AS _id", f"`{text_col}` AS _text"), run, f"_id {kind}, fp bigint"
    ).withColumnRenamed("_id", id_col)


def linked_pairs(values: DataFrame, distance: int = 2, col: str = "fp") -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints that connect all fingerprints
    within ``distance`` (0 to 2) of each other.

    Around one value all fingerprints are within 2 of each other, so a star to
    the smallest of them keeps the same components as all pairs would.
    """
    if not 0 <= distance <= 2:
        raise ValueError("ball hashing is built for distances up to 2")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(v).cast("bigint") for v in
                    [*(1 << b for b in range(63)), -(1 << 63)]] * (distance > 0))
    around = values.select(F.col(col).alias("_fp")).distinct().select("_fp", F.explode(flips).alias("_flip"))
    met = around.select("_fp", F.col("_fp").bitwiseXOR(F.col("_flip")).alias("_value"))
    w = Window.partitionBy("_value")
    pairs = (
        met.withColumn("a", F.min("_fp").over(w)).where("_fp <> a")
        .select("a", F.col("_fp").alias("b")).distinct()
    )
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)


def simhash_links(fps: DataFrame, distance: int = 2, node: str = "node") -> DataFrame:
    """Links ``a``, ``b`` between nodes whose components are those of all links of at most
    ``distance`` differing bits. ``fps`` has ``node`` and ``fp``; nodes with an equal
    fingerprint are linked to the smallest of them, which stands for it."""
    leads = cut_lineage(fps.groupBy("fp").agg(F.min(node).alias("_lead")))
    equal = fps.join(leads, "fp").where(F.col(node) != F.col("_lead")).select(F.col("_lead").alias("a"), F.col(node).alias("b"))
    low, high = leads.selectExpr("fp AS a", "_lead AS _low"), leads.selectExpr("fp AS b", "_lead AS _high")
    near = linked_pairs(leads, distance).join(low, "a").join(high, "b").selectExpr("_low AS a", "_high AS b")
    found = cut_lineage(equal.unionByName(near))
    release(leads)
    return found


def simhash_groups(docs: DataFrame, words: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``fp``, ``fingerprint`` (hex) and ``component_id``: the smallest id
    reachable over links of at most ``distance`` differing bits.

    Texts without words have fingerprint zero and are linked like any other.
    Repeated rows keep their own result rows; a NULL id stays NULL and never
    becomes a component id unless its component has no other id.
    """
    rows = cut_lineage(fingerprints(docs, words, id_col, text_col))
    classes = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    found = components(linked_pairs(classes, distance), "a", "b").withColumnsRenamed({"node": "fp", "component": "_root"})
    placed = classes.join(found, "fp", "left").withColumn("_root", F.coalesce("_root", "fp"))
    # One row per distinct fingerprint; the groups of a component are combined first.
    least = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    by_fp = placed.join(least, "_root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select(
        id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- near-duplicate texts: SimHash links, and links by shingles ------------

ROWS = 1000  # texts that a task gets at once
TILE = 512  # nodes of one side of a tile, about
TILE_SHINGLES = 1 << 18  # and their shingles
CROWD = 128  # nodes of a ball from which on it is compared in tiles
FEW = 8  # nodes of a ball from which on its sketches meet first
SKETCHES = 2048  # nodes of one side of a tile of sketches, about
SKETCH_SHINGLES = 1 << 22  # and their shingles
SAMPLE = 4096
COMMON = 200_000


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash

    tokens = (text or "").encode().lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    grams = [b" ".join(tokens)] if len(tokens) <= words else map(b" ".join, zip(*[tokens[i:] for i in range(words)]))
    return np.unique(np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams], np.uint64))


def first_tokens(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a text in the order of (count in ``common``, hash).

    Sets with a Jaccard similarity of at least ``similarity`` share at least that
    part of each of them, so if the order is the same for all texts, they
    share one of the first ``n - ceil(similarity * n) + 1``. This holds for any
    order; rare ones first makes few other texts meet.
    """
    n = len(shingles)
    if not n:
        return shingles
    at = np.searchsorted(common, shingles)
    at[at == len(common)] = 0
    count = np.where(common[at] == shingles, counts[at], 0) if len(common) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, count))[:n - int(np.ceil(similarity * n - 1e-9)) + 1]]


def _common_shingles(texts: DataFrame, n: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a hash sample of some SAMPLE different texts,
    sorted, and their counts: at most COMMON. They only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            sets = [shingle_set(t, words) for t in batch.column("_text").to_pylist()]
            for s in sets:
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["h"])

    some = texts.select("_text").where(F.pmod(F.xxhash64("_text"), F.lit(max(1, n // SAMPLE))) == 0).dropDuplicates()
    counted = map_batches(some, run, "h bigint").groupBy("h").count().where("count > 1")
    top = counted.orderBy(F.desc("count"), "h").limit(COMMON).toPandas()
    h, count = top["h"].to_numpy(np.int64).view(np.uint64), top["count"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], count[order]


def sketch(shingles: np.ndarray) -> bytes:
    """How many shingles end in each of 2^k patterns of low bits, one byte each; 255 means as many or more.
    There are two to four shingles a pattern, so the sketch is a sixteenth to a thirty-second of the set."""
    patterns = 1 << max(4, len(shingles).bit_length() - 2)
    return np.minimum(np.bincount((shingles & np.uint64(patterns - 1)).astype(np.int64), minlength=patterns), 255).astype(np.uint8).tobytes()


def most_common(x: bytes, y: bytes) -> float:
    """An upper bound of the shingles two sets share, from their sketches."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if a.max() == 255 or b.max() == 255:
        return np.inf
    patterns = min(len(a), len(b))
    # A longer sketch becomes a shorter one by leaving out its top bits.
    return int(np.minimum(a.reshape(-1, patterns).sum(axis=0), b.reshape(-1, patterns).sum(axis=0)).sum())


WIDTH = 5  # bytes kept of a shingle's hash


def packed_set(shingles: np.ndarray) -> bytes:
    """The low five bytes of the hashes, sorted: a chance match of two different
    shingles among a thousand on each side has a probability of 1e-6."""
    low = np.sort(shingles & np.uint64((1 << (8 * WIDTH)) - 1))
    return low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def unpacked_set(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WIDTH, 8), np.uint8)
    wide[:, :WIDTH] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return wide.view("<u8")[:, 0]


def _maybe(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Adds ``maybe``: whether the sketches of ``a`` and ``b`` leave a chance."""

    def run(batches):
        for batch in batches:
            maybe = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("_ka", "_kb", "_na", "_nb"))):
                maybe.append(most_common(x, y) * (1 + similarity) >= similarity * (n + m) - 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(maybe, pa.bool_())], ["a", "b", "maybe"])

    left = sets.selectExpr("node AS a", "sketch AS _ka", "size AS _na")
    right = sets.selectExpr("node AS b", "sketch AS _kb", "size AS _nb")
    return map_batches(pairs.join(left, "a").join(right, "b").select("a", "b", "_ka", "_kb", "_na", "_nb"), run, "a bigint, b bigint, maybe boolean")


def _sets_of(rows: DataFrame, node: str, sets: DataFrame, columns: tuple[str, ...] = ("shingles",)) -> DataFrame:
    """``node`` and ``columns`` of the nodes in the column ``node`` of ``rows``; other sets are dropped while
    they are scanned, so they are not shuffled."""
    wanted = small_side(rows.select(F.col(node).alias("node")).distinct())
    return sets.join(wanted, "node", "left_semi").select("node", *columns)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Adds ``ok``: whether the shingle sets of ``a`` and ``b`` are similar enough.
    Only sets of nodes in ``pairs`` leave the table."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("_sa").to_pylist(), batch.column("_sb").to_pylist()):
                x, y = unpacked_set(x), unpacked_set(y)
                both = len(np.intersect1d(x, y))
                union = len(x) + len(y) - both
                ok.append(union > 0 and both >= similarity * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    def side(node: str, column: str) -> DataFrame:
        return _sets_of(pairs, node, sets).select(F.col("node").alias(node), F.col("shingles").alias(column))

    return map_batches(pairs.join(side("a", "_sa"), "a").join(side("b", "_sb"), "b").select("a", "b", "_sa", "_sb"), run, "a bigint, b bigint, ok boolean")


def _possible(similarity: float, a: str, b: str):
    """Whether two nodes can be similar enough, by their shingle counts and by the
    places of the token they share: if it is their first one, nothing before it is common."""
    n, m = F.col(f"{a}._size"), F.col(f"{b}._size")
    most = F.least(n - F.col(f"{a}._pos"), m - F.col(f"{b}._pos"))
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (most * (1 + similarity) >= similarity * (n + m) - 1e-6)


def link_balls(met: DataFrame, shingles: DataFrame, similarity: float, known: DataFrame | None = None) -> DataFrame:
    """Links ``a``, ``b`` whose components are those of all similar pairs that share a ball.

    ``met`` has ``_ball``, ``node``, ``_size`` and ``_pos`` of balls with several nodes.
    In two rounds the smallest node of every ball is compared with the others,
    which joins most groups of copies by one comparison a text. It then leaves the
    ball, as every pair with it is tested. A ball stays while it holds more
    than one component; at last all pairs of nodes of different components in the
    remaining balls are compared. So no pair is left
    untested because its nodes were linked to others before. Links that are ``known``
    beforehand are kept, and what they settle is not compared again.

    What lies in balls of more than FEW nodes by then meets by its sketches (:func:`_chances`), and nodes
    that can be similar to none of another component leave the ball. So a text that shares a passage with
    many others is sent once a ball as a sketch, not as its whole set or a pair with each of them.

    Balls of more than CROWD nodes come first and never become pairs: their sets meet in
    tiles, which return links alone (:func:`_tile_links`). Tiles are first laid so
    that each node is in one of its ball, which joins most of a cloud of copies; then nodes outside
    the ball's largest component meet those of the other tiles.
    """
    by_ball = Window.partitionBy("_ball")
    item = F.struct("node", "_size", "_pos")
    found, judged, tiled = known, None, []

    def gather() -> None:
        nonlocal found
        links = [t.select("a", "b") for t in (known, judged and judged.where("ok"), *tiled) if t is not None]
        found = reduce(DataFrame.unionByName, links)

    def judge(pairs: DataFrame) -> None:
        nonlocal judged
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        if judged is None:
            pairs = pairs.distinct()
        else:  # counted, not joined: a broadcast by two columns takes a page of memory on every executor
            both = pairs.withColumn("_old", F.lit(False)).unionByName(judged.select("a", "b", F.lit(True).alias("_old")))
            pairs = both.groupBy("a", "b").agg(F.max("_old").alias("_old")).where("NOT _old").drop("_old")
        with batches_of(pairs.sparkSession, 256):  # two sketches or two whole sets a row
            tested = cut_lineage(_maybe(pairs, shingles, similarity))
            alike = cut_lineage(_similar(tested.where("maybe").select("a", "b"), shingles, similarity))
        now = alike.unionByName(tested.where("NOT maybe").select("a", "b", F.lit(False).alias("ok")))
        judged = now if judged is None else judged.unionByName(now)
        gather()

    def compare(tiles: DataFrame, inside: bool) -> None:
        tiles = cut_lineage(tiles)
        whole = tiles.join(_sets_of(tiles, "node", shingles), "node")
        tiled.append(cut_lineage(whole.groupBy("_ball", "_i", "_j").applyInArrow(_tile_links(similarity, inside), "a bigint, b bigint")))
        release(tiles)
        gather()

    def hopeful(rows: DataFrame) -> DataFrame:
        """The rows of small balls, and of other balls those whose sketches leave a chance."""
        sized = cut_lineage(_sized(rows, SKETCHES, SKETCH_SHINGLES))
        many, columns = sized.where(F.col("_n") > FEW), rows.columns
        if not many.limit(1).count():
            release(sized)
            return rows
        # A node that is on both sides of a tile is sent once.
        right = many.withColumn("_i", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_slices"), F.lit(1)) - 1))).withColumns(
            {"_j": F.col("_mine"), "_left": F.col("_minor") & (F.col("_slice") == F.col("_i")), "_right": F.lit(True)})
        left = many.where("_minor").withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).where("_j <> _mine").withColumns(
            {"_i": F.col("_slice"), "_left": F.lit(True), "_right": F.lit(False)})
        sent = ["_i", "_j", "_left", "_right", *columns]
        tiles = right.select(*sent).unionByName(left.select(*sent))
        whole = tiles.join(_sets_of(many, "node", shingles, ("size", "sketch")), "node")
        kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
        kept = cut_lineage(whole.groupBy("_ball", "_i", "_j").applyInArrow(_chances(similarity, columns), kinds))
        few = sized.where(F.col("_n") <= FEW).select(*columns)
        left_over = cut_lineage(few.unionByName(kept.distinct()))
        release(sized, kept, rows)
        return left_over

    def unsettled(rows: DataFrame) -> DataFrame:
        """Balls that hold several components, with the component of each node."""
        groups = components(found, "a", "b")
        placed = rows.join(groups, "node", "left").withColumn("_of", F.coalesce("component", "node")).drop("component")
        spread = placed.withColumns({"_first": F.min("_of").over(by_ball), "_last": F.max("_of").over(by_ball)})
        return cut_lineage(spread.where("_first < _last").drop("_first", "_last"))

    rows = met if known is None else unsettled(met)
    for _ in range(2):
        led = rows.withColumns({"_x": item, "_low": F.min(item).over(by_ball)})
        if "_of" in rows.columns:
            led = led.withColumn("_low_of", F.min_by("_of", "node").over(by_ball)).where("_of <> _low_of")
        pairs = led.where((F.col("node") != F.col("_low.node")) & _possible(similarity, "_x", "_low"))
        judge(pairs.select(F.col("node").alias("a"), F.col("_low.node").alias("b")))
        rest = rows.withColumn("_low", F.min("node").over(by_ball)).where("node <> _low").drop("_low", "_of")
        before, rows = rows, unsettled(rest)
        if before is not met:
            release(before)
    rows = hopeful(rows)
    crowds = cut_lineage(_sized(rows).where(F.col("_n") > CROWD))
    if crowds.limit(1).count():
        compare(crowds.withColumns({"_i": F.lit(-1), "_j": F.col("_mine"), "_left": F.col("_minor"), "_right": F.lit(True)}), True)
        rest = unsettled(crowds.where("_parts > 1").select("_ball", "node", "_size", "_pos"))
        if rest.limit(1).count():
            left = _sized(rest).withColumns({"_left": F.lit(True), "_right": F.lit(False)}).where("_minor").withColumns(
                {"_i": F.col("_slice"), "_j": F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))})
            right = _sized(rest).withColumns({"_left": F.lit(False), "_right": F.lit(True)}).withColumns(
                {"_i": F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)), "_j": F.col("_mine")})
            compare(left.unionByName(right), False)
        before, rows = rows, unsettled(rows.join(crowds.select("_ball").distinct(), "_ball", "left_anti").drop("_of"))
        release(before, rest)
    release(crowds)
    if rows.limit(1).count():
        judge(rows.groupBy("_ball").applyInArrow(_cross_pairs(similarity), "a bigint, b bigint"))
    release(rows)
    return found


def _sized(rows: DataFrame, most: int | None = None, most_shingles: int | None = None) -> DataFrame:
    """Adds ``_n`` (nodes of the ball), ``_minor`` (whether a node is outside the ball's largest
    component), the tile ``_mine`` of ``_parts`` and, among the minor ones, the tile ``_slice`` of ``_slices``; tiles have about
    ``most`` nodes (TILE) and ``most_shingles`` (TILE_SHINGLES)."""
    most, most_shingles = most or TILE, most_shingles or TILE_SHINGLES

    def tiles(nodes, shingles):
        return F.ceil(F.greatest(nodes / most, shingles / most_shingles)).cast("int")

    groups = rows.groupBy("_ball", "_of").agg(F.count("*").alias("_k"), F.sum("_size").alias("_s"))
    balls = groups.groupBy("_ball").agg(
        F.sum("_k").alias("_n"), F.sum("_s").alias("_all"), F.max(F.struct("_k", "_of", "_s")).alias("_major"))
    balls = balls.select(
        "_ball", "_n", F.col("_major._of").alias("_major"), tiles(F.col("_n"), F.col("_all")).alias("_parts"),
        tiles(F.col("_n") - F.col("_major._k"), F.col("_all") - F.col("_major._s")).alias("_slices"))
    code = F.xxhash64("node")
    return rows.join(balls, "_ball").withColumns(
        {"_minor": F.col("_of") != F.col("_major"), "_mine": F.pmod(code, "_parts").cast("int"), "_slice": F.pmod(code, "_slices").cast("int")}).drop("_major")


def _chances(similarity: float, columns: list[str]):
    """The rows of one tile, as ``columns``, whose sketch leaves a chance with one of another component:
    nodes that are ``_left`` against those that are ``_right``."""

    def run(table: pa.Table) -> pa.Table:
        of, n, size, pos = (table.column(c).to_numpy() for c in ("_of", "size", "_size", "_pos"))
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("_left", "_right"))
        raw = table.column("sketch").to_pylist()
        length, full = np.array([len(s) for s in raw], np.int64), np.array([255 in s for s in raw], bool)
        of_length = {p: right[length[right] == p] for p in np.unique(length[right]).tolist()}
        folded: dict[tuple[int, int], np.ndarray] = {}

        def fold(nodes, patterns: int, to: int) -> np.ndarray:
            counts = np.frombuffer(b"".join(raw[k] for k in nodes), np.uint8).reshape(len(nodes), patterns // to, to)
            return counts[:, 0] if patterns == to else counts.sum(axis=1, dtype=np.uint16)

        chance = np.zeros(len(raw), bool)
        for x in left:
            for p, y in of_length.items():
                # What has a chance already need not be compared with its like.
                fits = (of[y] != of[x]) & ~(chance[x] & chance[y])
                fits &= np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
                fits &= np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
                fits &= np.minimum(size[x] - pos[x], size[y] - pos[y]) * (1 + similarity) >= similarity * (size[x] + size[y]) - 1e-6
                at = np.flatnonzero(fits)
                if not len(at):
                    continue
                to = min(p, int(length[x]))
                if (p, to) not in folded:
                    folded[p, to] = fold(y, p, to)
                own = fold([x], int(length[x]), to)
                for k in range(0, len(at), 256):  # a few hundred KB at once
                    z = y[at[k:k + 256]]
                    both = np.minimum(folded[p, to][at[k:k + 256]], own).sum(axis=1, dtype=np.int64)
                    ok = (both * (1 + similarity) >= similarity * (n[x] + n[z]) - 1e-6) | full[x] | full[z]
                    chance[z[ok]] = True
                    chance[x] |= ok.any()
        return table.select(columns).filter(pa.array(chance))

    return run


def _tile_links(similarity: float, inside: bool):
    """Links that join what is similar in one tile: nodes that are ``_left`` against those that are
    ``_right`` and of the same tile ``_mine`` (``inside``) or of another one. Nodes that are linked
    already are not compared, so there are fewer links than components."""

    def run(table: pa.Table) -> pa.Table:
        node, of, size, pos, mine = (table.column(c).to_numpy() for c in ("node", "_of", "_size", "_pos", "_mine"))
        left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("_left", "_right"))
        sets = [unpacked_set(x) for x in table.column("shingles").to_pylist()]
        many = np.array([len(x) for x in sets])
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        # (shingle, node) once each, by shingle: the nodes of every shingle lie together.
        held = np.unique(code * len(sets) + np.repeat(np.arange(len(sets)), many))
        edges, owner = np.searchsorted(held, np.arange(len(values) + 1) * len(sets)), held % len(sets)
        at, of = np.cumsum(many) - many, of.copy()
        out_a, out_b = [], []
        for x in left:
            n, m = size[x], size[right]
            fits = (of[right] != of[x]) & ((mine[right] == mine[x]) == inside)
            fits &= np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
            fits &= np.minimum(n - pos[x], m - pos[right]) * (1 + similarity) >= similarity * (n + m) - 1e-6
            y = right[fits]
            if not len(y):
                continue
            own = np.unique(code[at[x]:at[x] + many[x]])
            shared = np.bincount(np.concatenate([owner[edges[c]:edges[c + 1]] for c in own.tolist()]), minlength=len(sets))[y]
            y = y[shared >= similarity * (many[x] + many[y] - shared)]
            groups, first = np.unique(of[y], return_index=True)
            out_a += [node[x]] * len(groups)
            out_b += node[y[first]].tolist()
            of[np.isin(of, groups)] = of[x]
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def _cross_pairs(similarity: float):
    """The pairs of one ball that are in different components and can be similar."""

    def run(table: pa.Table) -> pa.Table:
        node, of, size, pos = (table.column(c).to_numpy() for c in ("node", "_of", "_size", "_pos"))
        out_a, out_b = [], []
        for x in range(len(node)):
            n, m = size[x], size
            fits = (of != of[x]) & (node > node[x])
            fits &= np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9
            fits &= np.minimum(n - pos[x], m - pos) * (1 + similarity) >= similarity * (n + m) - 1e-6
            out_b.append(node[fits])
            out_a.append(np.full(len(out_b[-1]), node[x]))
        empty = np.empty(0, np.int64)
        return pa.table({"a": np.concatenate([empty, *out_a]), "b": np.concatenate([empty, *out_b])})

    return run


def _shared(balls: DataFrame) -> DataFrame:
    """The rows of balls that hold several nodes; balls that hold the same nodes become one.

    A copy shares many shingles with its original, and each would be a ball of the same two. A
    node has its first place among the balls that become one: the bound of :func:`_possible`
    only grows by that. A ball is named by a hash of what its nodes and sizes add up to; if two
    different ones got one name, their nodes would meet as well, so no pair is lost.
    """
    by_ball = Window.partitionBy("_ball")
    # Plain columns: a hash of each node would be one more column to shuffle. A sum that overflows is NULL.
    ends = balls.withColumns({
        "_first": F.min("node").over(by_ball), "_last": F.max("node").over(by_ball),
        "_xor": F.bit_xor("node").over(by_ball), "_sum": F.try_sum("node").over(by_ball),
        "_sizes": F.struct(F.bit_xor("_size").over(by_ball), F.try_sum("_size").over(by_ball))})
    named = ends.where("_first < _last").withColumn("_ball", F.xxhash64("_first", "_last", "_xor", "_sum", "_sizes"))
    return cut_lineage(named.groupBy("_ball", "node").agg(F.max("_size").alias("_size"), F.min("_pos").alias("_pos")))


def _with_digest(docs: DataFrame, text_col: str, name: str = "_digest") -> DataFrame:
    return docs.withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit("").cast("binary")), 256)))


def near_copy_nodes(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """``_digest``, ``_first`` (smallest id), ``_n`` (rows with both), ``node`` and ``component`` (numbers) of every different text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            found = [shingle_set(t, words) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([len(x) for x in found], pa.int64()), pa.array([sketch(x) for x in found], pa.binary()),
                 pa.array([packed_set(x) for x in found], pa.binary())], ["node", "size", "sketch", "shingles"])

    spark = docs.sparkSession
    slim = _with_digest(docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS _first", f"`{text_col}` AS _text").where("_first IS NOT NULL"), "_text")
    rows = slim.groupBy("_digest", "_first").agg(F.count("*").alias("_n"))
    least = rows.groupBy("_digest").agg(F.min(F.struct("_first", "_n")).alias("_l")).select("_digest", "_l.*")
    # Numbers are drawn while the table is written, so they are unique and stay.
    nodes = cut_lineage(least.withColumn("node", F.monotonically_increasing_id()))
    # One row stands for all copies of a text (a repeated row may come twice, which changes nothing).
    # It is written, as four jobs read it: each join would leave its broadcast of all digests in the executors' heap.
    texts = cut_lineage(slim.join(small_side(nodes.select("_digest", "_first", "node")), ["_digest", "_first"]).select("node", "_text"))
    with batches_of(spark, ROWS):
        near = simhash_links(cut_lineage(fingerprints(texts, id_col="node", text_col="_text")))
        common, counts = _common_shingles(texts, nodes.count(), words)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            sets = [shingle_set(t, words) for t in batch.column("_text").to_pylist()]
            first = [first_tokens(x, common, counts, similarity) for x in sets]
            many = [len(f) for f in first]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64)),
                 pa.array(np.repeat(batch.column("node").to_numpy(zero_copy_only=False), many)),
                 pa.array(np.repeat([len(x) for x in sets], many).astype(np.int32)),
                 pa.array(np.concatenate([np.empty(0, np.int64), *map(np.arange, many)]).astype(np.int32))],
                ["_ball", "node", "_size", "_pos"])

    with batches_of(spark, ROWS):
        met = _shared(map_batches(texts, tokens, "_ball bigint, node bigint, _size int, _pos int"))
        shingles = cut_lineage(map_batches(texts.join(small_side(met.select("node").distinct()), "node", "left_semi"), sets,
                                           "node bigint, size bigint, sketch binary, shingles binary"))
    release(texts)
    found = link_balls(met, shingles, similarity, near)
    groups = cut_lineage(components(found, "a", "b"))
    release(met, shingles, found)  # the files of `near` are among those of `found`
    return nodes.join(small_side(groups), "node", "left").withColumn("component", F.coalesce("component", "node"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``component_id`` of every row with an id, by near-copy links.

    Nodes are the different texts: equal texts are one, and two texts under one
    id are two (their rows may then have different components). Texts are linked by
    SimHash, as in :func:`simhash_groups`: fingerprints of 3-word shingles that differ in
    at most 2 bits meet on a ball. A cut tail or an added block changes more bits, so
    texts with a Jaccard similarity of at least ``similarity`` between their ``words``-word
    shingle sets are linked as well. Every such pair meets on one of its rarest shingles
    (:func:`first_tokens`), and all that meet are linked or compared
    (:func:`link_balls`), so no link is lost wherever the texts differ: in
    scattered words, a cut tail or an added block. ``component_id`` is the smallest
    id of the group; NULL and empty texts are copies of each other.
    """
    placed = cut_lineage(near_copy_nodes(docs, words, similarity, id_col, text_col))
    least = placed.groupBy("component").agg(F.min("_first").alias("component_id"))
    by_text = placed.join(small_side(least), "component").select("_digest", "component_id")
    rows = _with_digest(docs.selectExpr(f"CAST(`{id_col}` AS BIGINT) AS `{id_col}`", f"`{text_col}` AS _text").where(F.col(id_col).isNotNull()), "_text")
    return rows.select(id_col, "_digest").join(small_side(by_text), "_digest").select(id_col, "component_id")


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of every group the row with the
    smallest id stays, once if it is repeated. Rows without an id stay. Two unlike
    texts under one id both stay. Empty texts are copies of each other."""
    placed = cut_lineage(near_copy_nodes(docs, words, similarity, id_col, text_col))
    stay = placed.groupBy("component").agg(F.min_by(F.struct("_digest", "_first", "_n"), F.struct("_first", "node")).alias("s")).select("s.*")
    # The caller's columns may have any names.
    digest, first = free_name(docs, "_digest"), free_name(docs, "_first")
    key = [digest, first]
    stay = cut_lineage(stay)
    named = stay.select(F.col("_digest").alias(digest), F.col("_first").alias(first), "_n")
    keyed = _with_digest(docs, text_col, digest).withColumn(first, F.col(f"`{id_col}`").cast("bigint"))
    left = keyed.join(small_side(named.select(*key)), key, "left_semi")
    # A row that is repeated as a whole key is rare; only its copies are moved.
    several = cut_lineage(named.where("_n > 1").select(*key))
    if several.limit(1).count():
        once = left.join(small_side(several), key, "left_semi").dropDuplicates(key)
        left = left.join(small_side(several), key, "left_anti").unionByName(once)
    return left.select(*docs.columns).unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
