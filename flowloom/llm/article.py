"""Main text of web pages by equivalence classes of template tokens.

Every page is read as a sequence of tokens: element starts with their path, and
blocks of text. Over the pages of a host, tokens that occur equally often on
each page have the same occurrence vector and form an equivalence class. The
vectors are never built: a sum of hashes of (page, occurrences) stands for one,
combined before the shuffle, so a host with a third of all pages is no large
group. Classes found on enough pages are looked for on every page again: their
tokens must have one order on all pages (those that have not leave the class and are
classes of their own), a class must have enough tokens, and of two classes that
cross on some page instead of nesting the weaker one is discarded. What is left are the valid
classes. Together they are the host's template, and what lies between them are slots. The text of a page is what
fills the slots of its article; slots of menus, adverts and the like are not.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowloom.functions.ordered import small_side
from flowloom.llm.common import chunks, cut_lineage, map_batches, release
from flowloom.llm.hosts import url_parts

# Elements by their role.
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "area", "base", "col", "embed", "param", "track"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q",
          "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr"}
ARTICLE = {"article", "main"}
APART = {"nav", "footer", "aside", "form", "fieldset", "label", "legend", "head", "title", "menu", "dialog", "button", "select", "iframe", "object", "svg", "noscript", "template"}
RAW = {"script", "style", "textarea", "noscript", "template", "svg", "iframe"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
# Words of class, id and role names. A name sets an element apart if one of its
# parts is a role and the others are roles or plain words: "cookie-notice" and
# "ad-box" do, "has-sidebar", "share-enabled" and "comments-policy" do not.
ROLE_WORDS = set((
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo "
    "cookie cookies disqus footer masthead menu nav navbar navigation newsletter notice popup promo promotion related respond share sharing "
    "sidebar social sponsor sponsored subscribe toolbar widget widgets").split())
PLAIN_WORDS = set("area bar block body bottom box button buttons container content global icons inner item left link links list main outer page panel "
                  "post posts primary reader readers right secondary section site slot text top unit user users wrap wrapper".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|textarea|noscript|template|svg|iframe)\b(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+>.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>|<[!?/][^>]*(?:>|$)|[^<]+|<", re.S | re.I)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


def sets_apart(names: str) -> bool:
    """Whether class, id or role names say that an element is no part of an article."""
    for name in names.split():
        parts = [p for p in re.split(r"[-_]+|\d+", name.lower()) if p]
        if any(p in ROLE_WORDS for p in parts) and all(p in ROLE_WORDS or p in PLAIN_WORDS for p in parts):
            return True
    return False


class Element:
    """An element of a page: where it lies, what its name says, how much text it holds."""

    __slots__ = ("parent", "tag", "path", "named", "within", "chars", "apart", "own", "kept")

    def __init__(self, parent: "Element | None", tag: str, path: str, named: bool):
        self.parent, self.tag, self.path, self.named, self.chars = parent, tag, path, named, 0
        # Inside an article, counted from its own start.
        self.within = bool(parent and parent.within) or tag in ARTICLE
        self.apart = self.own = self.kept = False


def read_page(source: str) -> tuple[Counter, list[tuple[str, bool, bool, str]]]:
    """Element tokens with their counts, and blocks of text in order (see :func:`read_tokens`)."""
    order, blocks = read_tokens(source)
    return Counter(path for kind, path in order if kind == "e"), blocks


def read_tokens(source: str) -> tuple[list[tuple[str, str]], list[tuple[str, bool, bool, str]]]:
    """All tokens in order, ("e", path) for the start of an element and ("t", text) for a block, and the blocks.

    A block is (path, inside an article, set apart, text). Its white space is
    one space each, its character references are decoded. Quotes count only
    behind ``=``, as in HTML, so a loose apostrophe swallows nothing.

    The page's article is its longest ``<article>`` (else ``<main>``) that its name
    does not set apart; others count as well if they are half as long. What
    encloses it is never set apart, nor, without one, by its name what holds
    most of the text.
    """
    stack: list[Element] = []
    every: list[Element] = []
    order: list[tuple[str, str]] = []
    found: list[tuple[Element | None, str]] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                at = stack[-1] if stack else None
                found.append((at, text))
                order.append(("t", text))
                while at is not None:
                    at.chars += len(text)
                    at = at.parent

    for m in TOKEN.finditer(source):
        tag = m.group(3)
        if tag is None:
            text = m.group()
            if text[0] != "<" or text == "<":
                held.append(text)
            elif m.group(1):
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if m.group(2):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        if tag in CLOSES_ITSELF and stack and stack[-1].tag == tag:
            stack.pop()
        elif stack and stack[-1].tag == "p":
            stack.pop()  # a block element ends a paragraph
        above = stack[-1] if stack else None
        values = [a or b or c for _, a, b, c in NAMED.findall(m.group(4))] if m.group(4) else []
        path = f"{above.path if above else ''}/{tag}" + (f".{'.'.join(values).lower()}" if values else "")
        element = Element(above, tag, path, tag not in ("html", "body") and sets_apart(" ".join(values)))
        every.append(element)
        if not m.group(4).rstrip().endswith("/") or tag not in ("svg", "path"):
            stack.append(element)
        order.append(("e", path))
    flush()

    total = sum(len(t) for _, t in found)
    articles = [e for e in every if e.tag == "article" and not e.named] or [e for e in every if e.tag == "main" and not e.named]
    longest = max(articles, key=lambda e: e.chars, default=None)
    at = longest
    while at is not None:
        at.kept = True
        at = at.parent
    for e in every:
        above = e.parent
        most = longest is None and 2 * e.chars > total and (e.named or e.tag == "form")
        by_tag = e.tag in APART or (e.tag == "header" and not (above and above.within))
        e.apart = bool(above and above.apart) or ((by_tag and not (e.tag == "form" and most)) or (e.named and not most)) and not e.kept
        e.own = bool(above and above.own) or (longest is not None and e.tag == longest.tag and not e.named and 2 * e.chars >= longest.chars)
    return order, [(e.path, e.own, e.apart, t) if e else ("", False, False, t) for e, t in found]


def page_tokens(source: str | None) -> list[tuple[str, str]]:
    """The tokens of a page in order, ("e", path) or ("t", hash of a block)."""
    import xxhash

    return [(kind, x if kind == "e" else str(xxhash.xxh64_intdigest(x))) for kind, x in read_tokens(source or "")[0]]


def moved_tokens(sequence: list, members: list) -> list:
    """The tokens of a class that are not in its order on a page.

    ``members`` is the order of the class, ``sequence`` its tokens as the page has them. If each
    occurs once, all but a longest part in that order moved. If they occur several
    times and do not repeat in that order, they form no tuples, and all of them moved.
    """
    if sequence == members * (len(sequence) // len(members)):
        return []
    if len(sequence) > len(members):
        return members
    rank = {t: k for k, t in enumerate(members)}
    ends, chain = [], []  # the smallest last rank, and its place, of an ordered part of every length
    before = [-1] * len(sequence)
    for k, t in enumerate(sequence):
        at = bisect_left(ends, rank[t])
        ends[at:at + 1], chain[at:at + 1] = [rank[t]], [k]
        before[k] = chain[at - 1] if at else -1
    kept, k = set(), chain[-1]
    while k >= 0:
        kept.add(sequence[k])
        k = before[k]
    return [t for t in sequence if t not in kept]


def crossings(sequence: list, sizes: dict) -> set[tuple]:
    """Pairs of classes that do not nest on a page, smaller first. ``sequence`` has the class of every token; a
    class of k tokens occurs in tuples of k. Two tuples cross if each has a token between two of the other."""
    pairs, met = set(), Counter()
    still: list = []  # classes of the tuples that have tokens to come, by their beginning
    for c in sequence:
        if not met[c] % sizes[c]:
            still.append(c)
        met[c] += 1
        at = len(still) - 1 - still[::-1].index(c)
        pairs.update((min(c, x), max(c, x)) for x in still[at + 1:])
        if not met[c] % sizes[c]:
            del still[at]
    return pairs


def _on_pages(pages: DataFrame, classes: DataFrame, find, schema: str) -> DataFrame:
    """Rows of ``find`` for every page: of its tokens, as (kind, token), and its host's classes, a dictionary
    from (kind, token) to (class, place in the class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict] = {}
        for batch in chunks(batches, "html"):
            out = []
            for h, source, members in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "members")]):
                if h not in known:
                    if len(known) > 100:
                        known.clear()
                    known[h] = {(m["kind"], m["token"]): (m["class"], m["place"]) for m in members}
                out += [{"host": h, **row} for row in find(page_tokens(source), known[h])]
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    kinds = pa.schema([(c, pa.int64() if t == "bigint" else pa.string()) for c, t in (x.split() for x in schema.split(", "))])
    by_host = classes.groupBy("_host").agg(F.collect_list(F.struct("kind", "token", "class", "place")).alias("members"))
    at = pages.join(by_host, F.col("host").eqNullSafe(F.col("_host"))).select("host", "html", "members")
    return map_batches(at, run, schema)


def _moved(tokens: list, classes: dict) -> Iterator[dict]:
    found: dict[int, list] = {}
    for t in tokens:
        if t in classes:
            found.setdefault(classes[t][0], []).append(t)
    order: dict[int, list] = {}
    for t, (c, place) in sorted(classes.items(), key=lambda x: x[1]):
        order.setdefault(c, []).append(t)
    for c, sequence in found.items():
        for kind, token in moved_tokens(sequence, order[c]):
            yield {"kind": kind, "token": token}


def _crossed(tokens: list, classes: dict) -> Iterator[dict]:
    sizes = Counter(c for c, _ in classes.values())
    for a, b in crossings([classes[t][0] for t in tokens if t in classes], sizes):
        yield {"a": a, "b": b}


def _nesting(table: pa.Table) -> pa.Table:
    """The classes of a host that stay: those on more pages first, then the larger ones, unless
    they cross one that stays."""
    apart: dict[int, set] = {}
    rank: dict[int, tuple] = {}
    for r in table.to_pylist():
        if r["b"] is None:
            rank[r["a"]] = (r["pages"], r["size"], r["a"])
        else:
            apart.setdefault(r["a"], set()).add(r["b"])
            apart.setdefault(r["b"], set()).add(r["a"])
    stay: set[int] = set()
    for c in sorted(rank, key=rank.get, reverse=True):
        if not apart.get(c, set()) & stay:
            stay.add(c)
    return pa.table({"_host": pa.array([table.column("_host")[0].as_py()] * len(stay), pa.string()), "class": pa.array(sorted(stay), pa.int64())})


def classes_of(pages: DataFrame, support: float = 0.5, least_pages: int = 2, least_size: int = 2) -> DataFrame:
    """Members of the valid classes of every host: ``_host``, ``kind``, ``token``, ``class``, ``place`` and ``pages``.

    A class has the tokens of one occurrence vector. It is valid if it occurs on ``support`` of the pages and on
    ``least_pages``, has ``least_size`` tokens (a block of text counts its words), its tokens have one order on
    all pages, and its tuples nest with those of the others on all pages. A host has at most 1 / support
    times the tokens of its average page, so what is sent to a page is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in chunks(batches, "html"):
            out = {c: [] for c in ("_page", "host", "kind", "token", "n", "at", "size")}
            for p, h, source in zip(*[batch.column(c).to_pylist() for c in ("_page", "host", "html")]):
                order, _ = read_tokens(source or "")
                first: dict = {}
                for k, t in enumerate(order):
                    first.setdefault(t, k)
                for (kind, x), n in Counter(order).items():
                    for c, v in zip(out, (p, h, kind, x if kind == "e" else str(xxhash.xxh64_intdigest(x)), n, first[kind, x],
                                          1 if kind == "e" else len(x.split()))):
                        out[c].append(v)
            strings = ("host", "kind", "token")
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c in strings else pa.int64()) for c, v in out.items()], list(out))

    found = map_batches(pages.select("_page", "host", "html"), run,
                        "_page bigint, host string, kind string, token string, n bigint, at bigint, size bigint")
    # A page counts once for a token, so what their hashes make together stands for the occurrence vector. All
    # tokens of a class are on the same pages; the first of them gives the order to compare with.
    vectors = found.groupBy("host", "kind", "token").agg(
        F.bit_xor(F.xxhash64("_page", "n")).alias("class"), F.count("*").alias("pages"), F.min_by("at", "_page").alias("place"), F.max("size").alias("size"))
    sizes = pages.groupBy(F.col("host").alias("_host")).agg(F.count("*").alias("_all"))
    same_host = F.col("host").eqNullSafe(F.col("_host"))
    valid = cut_lineage(vectors.join(sizes, same_host).where((F.col("pages") >= support * F.col("_all")) & (F.col("pages") >= least_pages))
                        .select("_host", "kind", "token", "class", "place", "pages", "size"))
    moved = cut_lineage(_on_pages(pages, valid, _moved, "host string, kind string, token string").distinct())
    apart = moved.select(F.col("host").alias("_of"), F.col("kind").alias("_kind"), F.col("token").alias("_token"))
    ordered = valid.join(apart, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("kind") == F.col("_kind")) & (F.col("token") == F.col("_token")), "left")
    ordered = ordered.withColumn("class", F.when(F.col("_kind").isNull(), F.col("class")).otherwise(F.xxhash64("class", "kind", "token")))
    large = ordered.withColumn("_size", F.sum("size").over(Window.partitionBy("_host", "class"))).where(F.col("_size") >= least_size)
    large = cut_lineage(large.select("_host", "kind", "token", "class", "place", "pages", "_size"))
    crossed = _on_pages(pages, large, _crossed, "host string, a bigint, b bigint").distinct()
    none = F.lit(None).cast("bigint")
    ranks = large.groupBy("_host", F.col("class").alias("a")).agg(F.max("pages").alias("pages"), F.max("_size").alias("size"))
    every = ranks.select("_host", "a", none.alias("b"), "pages", "size").unionByName(
        crossed.select(F.col("host").alias("_host"), "a", "b", none.alias("pages"), none.alias("size")))
    stay = every.groupBy("_host").applyInArrow(_nesting, "_host string, class bigint")
    stay = stay.select(F.col("_host").alias("_of"), F.col("class").alias("_class"))
    out = cut_lineage(large.join(stay, F.col("_host").eqNullSafe(F.col("_of")) & (F.col("class") == F.col("_class")), "left_semi").drop("_size"))
    release(valid, moved, large)
    return out


def template(pages: DataFrame, support: float = 0.5, least_pages: int = 2) -> DataFrame:
    """Template of every host: ``host`` and ``tokens``, the paths in its valid classes (:func:`classes_of`),
    and ``texts``, hashes of the blocks in them.

    ``pages`` has ``_page``, ``host`` and ``html``.
    """
    return classes_of(pages, support, least_pages).groupBy(F.col("_host").alias("host")).agg(
        F.collect_list(F.when(F.col("kind") == "e", F.col("token"))).alias("tokens"),
        F.collect_list(F.when(F.col("kind") == "t", F.col("token"))).alias("texts"))


def nested(tokens: list[str]) -> set[str]:
    """Tokens whose enclosing tokens are all in the template."""
    every, out = set(tokens), set()
    for t in sorted(every, key=lambda t: t.count("/")):
        parent = t.rpartition("/")[0]
        if not parent or parent in out:
            out.add(t)
    return out


def fill(blocks: list[tuple[str, bool, bool, str]], tokens: set[str], texts: set[str]) -> str:
    """The text in the slots of the article.

    The slot of a block is its nearest enclosing template token. Blocks set
    apart are no article. If the page marks an article, it is what lies inside;
    otherwise the slots that hold text of this page alone: blocks that recur
    over the host are template.
    """
    import xxhash

    kept = [b for b in blocks if not b[2]]
    if any(b[1] for b in kept):
        return "\n".join(b[3] for b in kept if b[1])
    # A page whose every block recurs, such as a changed copy of another one, keeps them.
    own = [b for b in kept if str(xxhash.xxh64_intdigest(b[3])) not in texts] or kept

    def slot(path: str) -> str:
        while path and path not in tokens:
            path = path.rpartition("/")[0]
        return path

    if not own:
        return ""
    weight: Counter = Counter()
    for b in own:
        weight[slot(b[0])] += len(b[3])
    best = max(weight, key=lambda s: (weight[s], s))
    # All that lies in the element around the heaviest slot belongs to the article.
    around = best.rpartition("/")[0]
    return "\n".join(b[3] for b in own if slot(b[0]) == best or b[0] == around or b[0].startswith(around + "/"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", support: float = 0.5) -> DataFrame:
    """``id_col``, ``url_col``, ``text`` and ``n_chars`` (code points) of every page.

    NULL or empty html gives an empty text. Pages without a host form a host of
    their own. Repeated rows are pages of their own. Other columns are not read.
    """
    host, _ = url_parts(F.col(url_col))
    rows = cut_lineage(pages.select(
        F.monotonically_increasing_id().alias("_page"), F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("host"),
        F.col(html_col).alias("html"), F.xxhash64(html_col, F.length(html_col)).alias("digest")))
    # Equal pages of a host count once, or a copy would make its article a template.
    copies = rows.groupBy("host", "digest").agg(F.min("_page").alias("_page"), F.count("*").alias("n")).where("n > 1")
    again = small_side(copies.select("host", "digest", F.col("_page").alias("_one")))
    same = rows.select("_page", "host", "html", "digest").join(again, ["host", "digest"], "left")
    templates = cut_lineage(template(same.where("_one IS NULL OR _page = _one"), support))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, tuple[set, set]] = {}
        for batch in chunks(batches, "html"):
            out = []
            for h, source, tokens, texts in zip(*[batch.column(c).to_pylist() for c in ("host", "html", "tokens", "texts")]):
                if h not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[h] = nested(tokens or []), set(texts or [])
                out.append(fill(read_page(source or "")[1], *known[h]))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_url"), pa.array(out, pa.string()),
                                              pa.array([len(t) for t in out], pa.int64())], ["_id", "_url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    done = map_batches(rows.join(templates, "host", "left").select("_id", "_url", "host", "html", "tokens", "texts"), run,
                       f"_id {kind}, _url string, text string, n_chars bigint")
    return done.withColumnsRenamed({"_id": id_col, "_url": url_col})
