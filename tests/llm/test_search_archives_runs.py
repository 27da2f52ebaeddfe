"""Ranked search, page archives and periodic runs against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from flowloom.llm import queries, ranked, runs, warc

SF = "/root/testdata/sf0.001"


# Ranked search

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def ranked_by_hand(items, docs, k=10):
    bag = [Counter(terms(t)) for _, t in docs]
    n = [sum(b.values()) for b in bag]
    count, words = sum(x > 0 for x in n), sum(n)
    df = Counter(t for b in bag for t in b)
    out = []
    for item, text in items:
        scored = []
        for (doc, _), b, size in zip(docs, bag, n):
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * (25 + 75 * size * count // words)))
                    for t in terms(text) if b[t])
            if s > 0 and doc is not None:
                scored.append((-s, doc))
        out += [(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_ranked_search_equals_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice(["the", "The", "été", "Été", "x1", "日本", "a_b", "zz"]) + r.choice(["", "", str(r.randint(0, 9))])
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, "..."), (303, "the " * 5000), (None, "the été zz"), (5, docs[5][1]), (6, "another text of id 6 the")]
    docs += [(400 + i, "same text the zz x1") for i in range(40)]
    items = [(i, " ".join(word() for _ in range(r.randint(1, 9)))) for i in range(20)] + [(90, None), (91, ""), (92, "nowhere"), (93, "the the the zz")]
    d = spark.createDataFrame([(a, b, "z", 1) for a, b in docs], "doc_id long, text string, term string, n int").repartition(5)
    q = spark.createDataFrame([(a, b, 0) for a, b in items + items[:2]], "item_id long, text string, score int")
    want = ranked_by_hand(items, docs)
    got = ranked.rank_documents(q, d)
    assert sorted(map(tuple, got.collect())) == want
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "bigint", "bigint"]
    # Small groups mean more passes, not other rows.
    assert sorted(map(tuple, ranked.rank_documents(q, d, group_terms=30).collect())) == want
    assert ranked.rank_documents(q.limit(0), d).count() == 0
    assert ranked.rank_documents(q, d.limit(0)).count() == 0


def test_tiles_bound_every_partial_sum(monkeypatch):
    monkeypatch.setattr(ranked, "TERM_TILE", 7)
    monkeypatch.setattr(ranked, "QUERY_TILE", 4)
    rng = np.random.default_rng(1)
    key = np.unique(rng.integers(0, 10 * 50, 200))
    query, term, weight = key // 50, key % 50, rng.integers(0, 400, len(key))
    total = np.zeros((10, 50))
    for first, names, matrix in ranked.tiles(query, term, weight, limit=100):
        assert matrix.sum(axis=1).max() <= 100 and len(names) <= 7
        total[first:first + len(matrix), names] += matrix
    want = np.zeros((10, 50))
    want[query, term] = weight
    assert (total == want).all()


def test_tile_top_keeps_ties():
    best = ranked.Best(1, 2)
    best.add(0, np.array([[5, 7, 5, 5]]), np.array([9, 8, 3, 4]))
    best.add(0, np.array([[5, 0]]), np.array([1, 2]))
    assert best.score[0].tolist() == [7, 5] and best.id[0].tolist() == [8, 1]


# Archives

def pages_by_hand(rows, least=0):
    first = {}
    for i, html in rows:
        if i is not None:
            first[html or ""] = max(first.get(html or "", i), i)
    out = []
    for i, html in rows:
        body = (html or "").encode()
        leader = first.get(html or "") if len(body) >= least else None
        revisit = leader is not None and leader != i
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", leader if revisit else None))
    return sorted(out, key=repr)


ODD_PAGES = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.0\r\n\r\n"), (6, "x" * 3_000_000), (7, "\x00\x01"), (None, "a"), (None, "lone"), (5, "other"), (9, "b"), (9, "b"),
             *((100 + i, "hot") for i in range(60)), *((200 + i, f"page {i}\n") for i in range(100))]


def pages_frame(spark):
    return spark.createDataFrame([(i, "http://h/\r\nX: 1" if i == 2 else None if i == 4 else f"http://h/{i}", h, b"", 0) for i, h in ODD_PAGES],
                                 "page_id long, url string, html string, payload binary, offset int").repartition(4)


@pytest.mark.parametrize("least", [0, 2])
def test_archives_equal_brute_force(spark, least):
    got = warc.archive_pages(pages_frame(spark), least_bytes=least)
    assert sorted(map(tuple, got.collect()), key=repr) == pages_by_hand(ODD_PAGES, least)
    assert warc.archive_pages(pages_frame(spark).limit(0)).count() == 0


def test_many_groups_are_joined_by_shuffle(spark, monkeypatch):
    rows = [(i, f"p{i // 2 if i < 3000 else 0}") for i in range(3400)]  # 1,500 pairs and a hot payload
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    monkeypatch.setattr(warc, "HEAVY", 20)
    want = [(r.page_id, r._leader) for r in warc.record_types(df).orderBy("page_id").collect()]
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 10)
    assert [(r.page_id, r._leader) for r in warc.record_types(df).orderBy("page_id").collect()] == want
    assert [(i, x[4]) for i, x in zip(range(3400), sorted(pages_by_hand(rows)))] == want


def test_every_record_is_a_member_and_the_index_leads_to_it(spark, tmp_path):
    warc.write_archives(pages_frame(spark), f"{tmp_path}/raw", file_records=20)
    raw = [p for p in (tmp_path / "raw").iterdir() if p.suffix == ".gz"]
    assert len(raw) > 4 and all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.0") for p in raw)
    index = warc.normalise(spark, f"{tmp_path}/raw", f"file://{tmp_path}/split")
    rows = index.orderBy("file", "record").collect()
    assert len(rows) == len(ODD_PAGES)
    whole = {}
    for r in rows:
        data = open(r.file.removeprefix("file://"), "rb").read()
        assert r.offset == whole.get(r.file, 0)  # gapless
        whole[r.file] = r.offset + r.length
        record = gzip.decompress(data[r.offset:r.offset + r.length])
        assert record.startswith(b"WARC/1.0\r\nWARC-Type: " + r.record_type.encode()) and record.endswith(b"\r\n\r\n") and r.record_id.encode() in record
    assert all(len(open(f.removeprefix("file://"), "rb").read()) == n for f, n in whole.items())
    # Rewriting split archives gives the same members.
    again = warc.normalise(spark, f"{tmp_path}/split", f"file://{tmp_path}/again")
    assert [(r.offset, r.length) for r in again.orderBy("file", "record").collect()] == [(r.offset, r.length) for r in rows]
    payloads = {r.payload for r in warc.read_records(index, with_payload=True).where("record_type = 'response'").collect()}
    assert payloads == {(h or "").encode() for _, h in ODD_PAGES}


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.gz").write_bytes(gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"))
    with pytest.raises(Exception, match="does not lead to its end"):
        warc.normalise(spark, f"{tmp_path}/raw", f"{tmp_path}/split").count()


# Periodic runs

def runs_by_hand(w, least=6, repeats=4):
    n, out = len(w), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            m = j - i + q
            if j > i and m >= max(least, repeats * q) and not any(w[i:i + m - p] == w[i + p:i + m] for p in range(1, q)):
                out.append((i, m, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(r):
    w = []
    for _ in range(r.randint(0, 6)):
        block = [r.choice("abcde"[:r.randint(1, 5)]) for _ in range(r.randint(1, 10))]
        w += block if r.random() < .4 else (block * r.randint(2, 9))[:r.randint(1, 60)]
    return w


@pytest.mark.parametrize("least,repeats", [(6, 4), (2, 2), (5, 3), (12, 4)])
def test_runs_equal_brute_force(least, repeats, monkeypatch):
    r = random.Random(least)
    for pairs in (1 << 20, 10):  # one block of lags, and many
        monkeypatch.setattr(runs, "PAIRS", pairs)
        for _ in range(300):
            w = random_words(r)
            code = np.array([ord(c) for c in w], np.int64)
            assert sorted(runs.runs_of(code, np.zeros(len(w), np.int64), least, repeats), key=lambda x: (x[0], x[2])) == runs_by_hand(w, least, repeats), w


def test_find_runs_on_texts(spark):
    r = random.Random(8)
    texts = [None, "", " \t\r\n", "a " * 6, "a " * 5, "  a b " * 4, "A a " * 7, "x" * 100_000, "to be or " * 30_000]
    texts += [" ".join(random_words(r)) for _ in range(60)] + ["a b " * 9] * 3
    df = spark.createDataFrame([(i, t, [], "c") for i, t in enumerate(texts)], "doc_id long, text string, runs array<int>, collapsed string").repartition(4)
    for row in runs.find_runs(df).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[row.doc_id] or "")
        want = runs_by_hand(w) if len(w) < 5000 else [(0, 90_000, 3)]
        drop = {i for s, m, q in want for i in range(s + q, s + m)}
        assert (row.n_words, [tuple(x) for x in row.runs]) == (len(w), want)
        assert row.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    assert runs.find_runs(df.limit(0)).count() == 0


def test_run_query(spark):
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = 0
    for row in queries.op13_periodic_runs(spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[row.doc_id] or "")
        n, h = len(w), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        code = np.array(list(map({x: i for i, x in enumerate(dict.fromkeys(w))}.get, w)), np.int64)
        found = runs_by_hand(w) if n < 600 else sorted(runs.scan(code, 6, 4), key=lambda x: (x[0], x[2]))
        seen += bool(found)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        drop = {i for s, m, q in found for i in range(s + q, s + m)}
        assert (row.n_runs, row.start, row.length, row.period) == (len(found), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if found else None)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()
    assert seen > 5
