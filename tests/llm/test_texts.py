"""Text operators against brute force, libraries and edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from flowloom.llm import packing, perplexity, pieces, pii, simhash, suffixes

EDGE = [None, "", " ", "\n", "a", "the cat sat on the mat " * 2000, "the cat sat on the mat", "the cat sat on the mat", "é😀 日本 ▁x  y", "\x00\x01a@b.co\x02"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, length int").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, length int")


def odd_texts(seed, n=300):
    r = random.Random(seed)
    return EDGE + ["".join(r.choice("abcdeth inrs \n.,▁é日'!1") for _ in range(r.randint(1, 300))) for _ in range(n)] + ["a" * 300, "ab" * 400, "then" * 100]


def test_piece_codec_equals_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.tokenizer_path("piece_bpe_32k.model"))
    texts = odd_texts(1)
    got = {r.doc_id: r for r in pieces.piece_codec(frame(spark, texts), with_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = sp.encode(t or "", add_eos=True)
        assert got[i].ids == want, t
        assert got[i].decoded == sp.decode(want), t
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
    assert pieces.piece_codec(empty(spark)).count() == 0


def test_decode_of_loose_bytes():
    m = pieces.piece_model(pieces.tokenizer_path("piece_bpe_32k.model"))
    assert m.decode([m.byte_ids[0xFF], m.byte_ids[0x41]]) == "\ufffdA"
    assert m.decode([]) == ""


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(pieces.tokenizer_path("word_bpe_49k.json"))
    texts = odd_texts(2) + ["It's <|endoftext|> HERE " * 900]
    rows = packing.pack(packing.pieces(frame(spark, texts), 2048, with_ids=True)).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert sum((list(p.ids) for p in parts), []) == t.encode(text or "", add_special_tokens=False).ids + [0]
        assert all(p.length == 2048 for p in parts[:-1]) and [p.start for p in parts] == [2048 * k for k in range(len(parts))]
    for members in by_seq.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 2048) + 1
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_all_capacities_hold(rule):
    lengths = np.random.default_rng(3).integers(1, 200, 500)
    room = packing.Capacity(tokens=512, pieces=6, attention=60_000)
    bins = packing.vector_best_fit(lengths, room, rule)
    for b in np.unique(bins):
        x = lengths[bins == b]
        assert x.sum() <= 512 and len(x) <= 6 and (x * x).sum() <= 60_000
    with pytest.raises(ValueError):
        packing.vector_best_fit(np.array([300]), room)


def test_simhash_groups_by_brute_force(spark):
    import xxhash

    r = random.Random(4)
    base = [" ".join(r.choice("ab cd ef gh ij kl mn op".split()) for _ in range(60)) for _ in range(8)]
    texts = EDGE + [b + r.choice(["", " x", " y z"]) for b in base for _ in range(5)]

    def fp(t):
        w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
        s = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    f = [fp(t) for t in texts]
    root = list(range(len(f)))
    for _ in f:
        for i in range(len(f)):
            for j in range(len(f)):
                if bin(f[i] ^ f[j]).count("1") <= 2:
                    root[i] = min(root[i], root[j])
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.simhash_groups(frame(spark, texts)).collect()}
    assert got == {i: (f"{f[i]:016x}", root[i]) for i in range(len(f))}
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_near_copies_keep_one(spark):
    r = random.Random(5)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for k in range(12):
        w = [r.choice(words) for _ in range(150)]
        texts += [" ".join(w), " ".join(w), " ".join(w[:70] + ["zz"] + w[71:])]
    kept = simhash.drop_near_copies(frame(spark, texts)).collect()
    assert sorted(x.doc_id for x in kept) == list(range(0, 36, 3))
    twice = frame(spark, texts[:1]).unionByName(frame(spark, texts[:1]))
    assert simhash.drop_near_copies(twice).count() == 1
    assert simhash.drop_near_copies(empty(spark)).count() == 0
    unnamed = spark.createDataFrame([(None, "a b c"), (None, "a b c")], "doc_id long, text string")
    assert simhash.drop_near_copies(unnamed).count() == 2


def brute_groups(texts, similarity=0.8):
    """Smallest member of each text's group, by comparing all pairs."""
    sets = [set(zip(*[t.split()[i:] for i in range(5)])) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i in range(len(texts))}


def test_linked_texts_are_compared_further(spark):
    # One ball: A~X and B~C, and X~B although both have partners by then. 40 others are like none.
    sets = {1: range(0, 100), 5: range(10, 110), 2: range(20, 120), 6: range(30, 130)}
    sets |= {10 + i: range(1000 * i + 1000, 1000 * i + 1100) for i in range(40)}
    sets |= {60: range(1000, 1105), 61: range(20_000, 20_104), 0: range(500, 600)}
    met = spark.createDataFrame([(7, n, 0, 0) for n in sets], "_ball long, node long, _size int, _pos int")
    rows = [(n, len(s), bytearray(simhash.sketch(np.array(s, np.uint64))), bytearray(simhash.packed_set(np.array(s, np.uint64)))) for n, s in sets.items()]
    found = simhash.link_balls(met, spark.createDataFrame(rows, "node long, size long, sketch binary, shingles binary"), 0.8)
    from flowloom.llm.common import components
    got = {x.node: x.component for x in components(found, "a", "b").collect()}
    assert got == {1: 1, 5: 1, 2: 1, 6: 1, 10: 10, 60: 10, 29: 29, 61: 29}


def test_sketches_bound_and_sets_are_packed():
    rng = np.random.default_rng(2)
    for n, m, both in ((1, 1, 1), (5, 0, 0), (500, 700, 300), (500, 520, 0), (3000, 9000, 2000), (1000, 1023, 900)):
        pool = np.unique(rng.integers(0, 2**64, n + m, np.uint64))
        x, y = np.sort(pool[:n]), np.sort(pool[n - both:n - both + m])
        share = len(np.intersect1d(x, y))
        assert share <= simhash.most_common(simhash.sketch(x), simhash.sketch(y)) <= max(n, m)
        assert simhash.unpacked_set(simhash.packed_set(x)).tolist() == sorted(int(v) % (1 << 40) for v in x)
    same = np.arange(10_000, dtype=np.uint64) << np.uint64(20)  # all end in the same bits
    assert simhash.most_common(simhash.sketch(same), simhash.sketch(same)) == np.inf


def test_one_id_with_two_texts_keeps_both(spark):
    a, b = " ".join("a%d" % i for i in range(60)), " ".join("b%d" % i for i in range(60))
    docs = spark.createDataFrame([(5, a, "x", b"d"), (5, b, "y", b"d"), (7, b + " more", "z", b"d"), (9, a, "w", b"d")],
                                 "doc_id long, text string, _first string, _digest binary")
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r._first for r in kept.collect()) == ["x", "y"]
    assert sorted((r.doc_id, r.component_id) for r in simhash.near_copies(docs).collect()) == [(5, 5), (5, 5), (7, 5), (9, 5)]
    near = spark.createDataFrame([(5, b), (5, b + " more")], "doc_id long, text string")  # alike under one id
    assert simhash.drop_near_copies(near).count() == 1


def test_chains_of_copies_are_one_group(spark):
    r = random.Random(15)
    words = ["w%d" % i for i in range(4000)]
    texts = []
    for _ in range(12):
        w = [r.choice(words) for _ in range(200)]
        for step in range(8):
            texts.append(" ".join(w))
            for at in r.sample(range(5, 195), 3):
                w[at] = "z%d" % r.randrange(10**6)
    r.shuffle(texts)
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_cut_and_appended_blocks_meet(spark):
    r = random.Random(16)
    words = ["w%d" % i for i in range(4000)]
    some = lambda n: [r.choice(words) for _ in range(n)]
    # Every text has a passage that all have.
    shared, texts = some(30), []
    for k in range(24):
        w = some(60) + shared + some(160)
        copies = [w[:-25], w[:-48], w[20:], w + some(27), some(60) + w, w[:100] + some(40) + w[100:], w[:-50], w + some(70)]
        texts += [" ".join(x) for x in (w, copies[k % 8], copies[(3 * k + 1) % 8])]
    want = brute_groups(texts)
    assert sum(i != c for i, c in want.items()) > 20
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, texts)).collect()}
    assert got == want


@pytest.mark.parametrize("largest", [20_000, 1])
def test_repeats_by_brute_force(spark, largest):
    r = random.Random(6)
    base = ["".join(r.choice("abcé \n") for _ in range(r.randint(50, 900))) for _ in range(10)]
    texts = [None, "", "x", "a" * 700, "ab" * 300]
    for _ in range(40):
        b, c = r.choice(base), r.choice(base)
        texts.append(b[r.randint(0, 60):r.randint(300, 900)] + "".join(r.choice("xyz ") for _ in range(r.randint(1, 200))) + c)
    texts += texts[10:13]
    seen = defaultdict(list)
    raw = [(t or "").encode() for t in texts]
    for i, t in enumerate(raw):
        for p in range(len(t) - 199):
            seen[t[p:p + 200]].append((i, p))
    cut = [np.zeros(len(t), bool) for t in raw]
    for places in seen.values():
        for i, p in places if len(places) > 1 else []:
            cut[i][p:p + 200] = True
    rows = frame(spark, texts)
    got = {x.doc_id: x for x in suffixes.cut_repeats(rows, 200, largest_group=largest).collect()}
    for i, t in enumerate(raw):
        assert got[i].n_removed == cut[i].sum() and got[i].n_bytes == len(t)
        assert got[i].n_spans == (np.diff(np.r_[0, cut[i].astype(int)]) == 1).sum()
        assert got[i].kept_sha256 == hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~cut[i]])).hexdigest()
    # A row given twice removes itself from both.
    double = frame(spark, ["q" + "".join(random.Random(9).choice("abcdef") for _ in range(400))] * 1)
    assert [x.n_removed for x in suffixes.cut_repeats(double.unionByName(double)).collect()] == [401, 401]
    assert suffixes.cut_repeats(empty(spark)).count() == 0


def test_deep_shallow_sort():
    r = random.Random(7)
    for _ in range(60):
        n, width = r.randint(1, 60), 8 * r.randint(1, 6)
        rows = np.array([[r.choice([0, 1, 255]) if r.random() < 0.1 else 0 for _ in range(width)] for _ in range(n)], np.uint8)
        group = np.array([r.randint(0, 3) for _ in range(n)])
        order, lcp = suffixes.deep_shallow_sort(rows, group)
        keys = [(group[i], rows[i].tobytes()) for i in order]
        assert keys == sorted(keys)
        for a, b, common in zip(keys, keys[1:], lcp[1:]):
            same = next((k for k in range(width) if a[1][k] != b[1][k]), width)
            assert common == (same if a[0] == b[0] else -1)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t):
            d = [int(c) for c in m.group() if c in "0123456789"]
            twice = [x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))]
            ok = {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group().split(".")),
                  "card": 12 <= len(d) <= 19 and sum(twice) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_by_brute_force(spark):
    r = random.Random(8)
    bits = ["1.2.3.4", "+49 30 1234567", "x@y.com", "4111111111111111", "300.1.1.1", "12", "-", ".", "a.b@c", "@d.e", "é"]
    texts = EDGE + ["a@b.c_x@d.e.f @@ x@y@z.com", "1.2.3.4.5.6.7.8 001.2.3.0004", "a@" + "b." * 30000 + "c", "1 " * 20000, "9" * 30000]
    texts += ["".join(r.choice("ab12.@+-_ ()é😀%0") for _ in range(r.randint(1, 120))) for _ in range(300)]
    texts += [" ".join(r.choice(bits) for _ in range(r.randint(1, 12))) for _ in range(200)]
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
        assert got[i].n_ip == want.count("ip:")
    assert pii.find_pii(empty(spark)).count() == 0


def test_labelers_add_spans_and_masking(spark):
    texts = ["call 555 123 4567, Dr. John Smith token = \"abcdef0123456789\"", "nothing here", None, "x@y.com and x@y.com"]
    masked = {x.doc_id: x.text for x in pii.mask_pii(frame(spark, texts)).collect()}
    assert masked[1] == "nothing here" and masked[2] is None
    assert masked[3] == "[EMAIL] and [EMAIL]"
    assert "abcdef0123456789" not in masked[0]


def test_long_tokens_are_covered_whole(spark):
    r = random.Random(8)
    key = "".join(r.choice("abcdefXYZ_-") for _ in range(3000))
    digest = hashlib.sha512(b"x").hexdigest()
    local = "a" * 200
    texts = [f"my token: {key} end", f"password {digest} end", f"mail {local} [at] example [dot] com end"]
    found = {x.doc_id: x._spans for x in pii.candidates(frame(spark, texts)).collect()}
    places = [{(s.kind, s.start, s.end) for s in found[i]} for i in range(3)]
    assert ("secret", 3, 3 + len("token: ") + 3000) in places[0]
    assert ("secret", 9, 9 + 128) in places[1]
    assert ("email", 5, len(texts[2]) - 4) in places[2]
    masked = {x.doc_id: x.text for x in pii.mask_pii(frame(spark, texts)).collect()}
    assert masked[0] == "my [SECRET] end"


def test_expectation_maximisation_finds_good_labelers():
    votes = [{"kind": "card", "shape": 1, "gazetteer": 2, "context": 1, "border": 1, "n": 90},
             {"kind": "card", "shape": 0, "gazetteer": 2, "context": 2, "border": 0, "n": 200},
             {"kind": "card", "shape": 0, "gazetteer": 2, "context": 0, "border": 0, "n": 50}]
    posterior, rate = pii.estimate(votes)
    assert posterior["card", 1, 2, 1, 1] > 0.9 > 0.1 > posterior["card", 0, 2, 0, 0]
    assert rate["shape"][0] > rate["shape"][1]
    assert pii.estimate([])[0] == {}


def test_perplexity_model(spark):
    texts = ["the cat sat on the mat and the dog ran to the cat. " * 3] * 20 + ["zq$$ xx## @@!! " * 9, None, ""]
    docs = frame(spark, texts)
    model = perplexity.train(docs.where("doc_id < 20"))
    table = perplexity.log_table(model[1])
    sums = np.exp(table.astype(float)).reshape(-1, perplexity.A).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in perplexity.judge(docs, labels).collect()}
    assert all(got[i].kept for i in range(20)) and not got[20].kept
    assert not got[21].kept and got[22].perplexity is None
    assert all(x.kept for x in perplexity.judge(docs.where("doc_id < 21"), labels.limit(0)).collect())
    assert perplexity.judge(empty(spark), labels).count() == 0


def test_counts_of_grams():
    own = "abc"
    code, n = perplexity.grams(["ab", None, "c"], own)
    assert n.tolist() == [2, 0, 1] and len(code) == 3
    a, b, c = range(3)
    s = perplexity.SPACE
    as_code = lambda *x: int(sum(v * perplexity.A ** (3 - i) for i, v in enumerate(x)))
    assert code.tolist() == [as_code(s, s, s, a), as_code(s, s, a, b), as_code(s, s, s, c)]


def kneser_ney_by_hand(trusted, order=4, symbols=42):
    """Interpolated modified Kneser-Ney over lists of symbols, as dictionaries: a function (context, symbol) -> probability."""
    levels = [defaultdict(int)]
    for t in trusted:
        for i in range(len(t) - order + 1):
            levels[0][tuple(t[i:i + order])] += 1
    for _ in range(order - 1):
        lower = defaultdict(int)
        for g in levels[0]:
            lower[g[1:]] += 1
        levels.insert(0, lower)
    tables = []
    for counts in levels:
        n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.0
        d = [min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, freed = defaultdict(int), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            freed[g[:-1]] += d[min(c, 3) - 1]
        tables.append((counts, d, total, freed))

    def p(context, x):
        counts, d, total, freed = tables[len(context)]
        lower = p(context[1:], x) if context else 1 / symbols
        if context not in total:
            return lower
        c = counts.get((*context, x), 0)
        return (c - (d[min(c, 3) - 1] if c else 0)) / total[context] + freed[context] / total[context] * lower

    return p


def test_perplexity_equals_a_model_by_hand(spark):
    r = random.Random(4)
    scripts = ["the a cat on mat. ", "και το ένα για ", "как это было и не ", "日本語の文は短い。"]
    texts = ["".join(r.choice(scripts[k % 4]) for _ in range(r.randint(1, 120))) for k in range(60)] + ["Ab 1!", "", "X" * 9]
    docs = frame(spark, texts)
    own = perplexity.alphabet(docs)
    counts = defaultdict(int)
    for c in "".join(texts):
        counts[c] += not (c.isspace() or c.isdigit())
    assert own == "".join(sorted((c for c in counts if counts[c]), key=lambda c: (-counts[c], ord(c)))[:perplexity.OWN])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    got = {x.doc_id: x for x in perplexity.judge(docs, labels).collect()}
    own = perplexity.alphabet(docs.where("doc_id < 40"))  # the model's own alphabet
    table = perplexity._fold_table(own)
    folded = [[perplexity.SPACE] * 3 + [int(table[ord(c)]) for c in t] for t in texts]
    p = kneser_ney_by_hand(folded[:40])
    for i, t in enumerate(texts):
        if t:
            logs = [np.log(max(p(tuple(folded[i][k - 3:k]), folded[i][k]), 1e-7)) for k in range(3, len(folded[i]))]
            assert got[i].perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-3)


@pytest.mark.parametrize("letters", ["αβγδεηικλμνορστυ", "абвгдеиклмнопрст", "的一是不了人我在有他这中大来上国"])
def test_junk_is_told_in_every_script(spark, letters):
    r = random.Random(len(letters))
    words = ["".join(r.choice(letters) for _ in range(r.randint(2, 5))) for _ in range(12)]
    good = [" ".join(r.choice(words) for _ in range(80)) for _ in range(25)]
    junk = ["".join(r.choice(letters + " ") for _ in range(300)) for _ in range(5)]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    kept = {x.doc_id for x in perplexity.judge(frame(spark, good + junk), labels).where("kept").collect()}
    assert kept == set(range(25))


def test_other_columns_may_have_any_name(spark):
    long = "the same passage of words that two documents share, long enough to be cut. " * 4
    names = ["_id", "_row", "_cut", "_key", "_text", "_docs", "n_symbols", "log_prob", "adjusted", "_lang", "base", "found", "_spans", "kept_text", "a b"]
    rows = [(i, t, "en", *[f"{n}{i}" for n in names]) for i, t in enumerate([long + "one", long + "two", None, "mail a@b.co now", ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join("`%s` string" % n.replace("`", "``") for n in names))
    labels = spark.createDataFrame([(0, 1), (3, 1)], "doc_id long, quality int")
    judged = perplexity.judge(docs, labels)
    assert judged.select("doc_id", "_lang", "base", "log_prob").orderBy("doc_id").first() == (0, "_lang0", "base0", "log_prob0")
    assert judged.columns.count("n_symbols") == 1 and judged.schema["n_symbols"].dataType.simpleString() == "bigint"
    cut = {r.doc_id: r for r in suffixes.cut_repeats(docs).collect()}
    assert (cut[1]["_id"], cut[1]["_cut"], cut[1].n_removed > 200, cut[2].kept_text) == ("_id1", "_cut1", True, None)
    masked = pii.mask_pii(docs)
    assert masked.columns == docs.columns
    assert masked.where("doc_id = 3").select("text", "base", "found", "_spans").first() == ("mail [EMAIL] now", "base3", "found3", "_spans3")


def test_characters_of_one_class_are_told_apart(spark):
    r = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(300)]  # all but 37 share a symbol
    write = lambda some: "".join(r.choice(some) for _ in range(200))
    good = [write(letters) for _ in range(40)]
    other = [write([chr(0x6E00 + i) for i in range(300)]) for _ in range(4)]
    labels = spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int")
    docs = frame(spark, good + other)
    own, _, (at, n) = perplexity.train(docs.where("doc_id < 30"))
    assert dict(zip(at.tolist(), n.tolist())) == {ord(c): "".join(good[:30]).count(c) for c in set("".join(good[:30]))}
    p, symbol = np.exp(perplexity.within_class(own, at, n).astype(float)), perplexity._fold_table(own)
    assert np.allclose(np.bincount(symbol, p, minlength=perplexity.A)[len(own):], 1, atol=1e-3)
    got = {x.doc_id: x for x in perplexity.judge(docs, labels).collect()}
    kept = {i for i in got if got[i].kept}
    assert set(range(30)) <= kept and len(kept & set(range(30, 40))) >= 8 and not kept & set(range(40, 44))
    # By their symbols alone the others would be the best texts of all.
    assert max(got[i].perplexity for i in range(40, 44)) < min(got[i].perplexity for i in range(40))
    rest = sum(np.log(p[ord(c)]) for c in good[35])
    assert got[35].char_perplexity == pytest.approx(got[35].perplexity * np.exp(-rest / 200), rel=1e-4)


def test_near_copies_are_linked_by_simhash(spark):
    r = random.Random(9)
    passage = " ".join("p%d" % i for i in range(11))  # an odd number: no bit is a tie
    # One passage for the most part, and ends that make the shingle sets unlike.
    texts = [(passage + " ") * 300 + " ".join("%s%d" % (r.choice("xyz"), r.randrange(10**6)) for _ in range(8)) for _ in range(4)]
    texts += [" ".join("w%d" % r.randrange(10**6) for _ in range(80)) for _ in range(4)]
    assert len(set(brute_groups(texts).values())) == 8
    want = {x.doc_id: x.component_id for x in simhash.simhash_groups(frame(spark, texts)).collect()}
    assert len(set(want.values())) == 5
    assert {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, texts)).collect()} == want
    assert sorted(x.doc_id for x in simhash.drop_near_copies(frame(spark, texts)).collect()) == [0, 4, 5, 6, 7]


def test_shuffle_files_go_with_the_stage(tmp_path):
    import subprocess
    import sys

    # A session of its own: the other tests' files lie in the same folder.
    code = """
import glob, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.local.dir", sys.argv[1]).config("spark.ui.enabled", "false").getOrCreate()
from flowloom.session import DROP_SHUFFLES, cut_lineage
rows = cut_lineage(spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").count())
assert rows.count() == 7 and spark.conf.get(DROP_SHUFFLES, None) in (None, "false"), spark.conf.get(DROP_SHUFFLES, None)
again = cut_lineage(rows.repartition(3, "k"))
assert sorted(again.collect()) == sorted(rows.collect())
import time; time.sleep(1)
before = set(glob.glob(sys.argv[1] + "/**/shuffle_*_*_*.data", recursive=True))
cut_lineage(rows.repartition(3, "k"))
time.sleep(1)
after = set(glob.glob(sys.argv[1] + "/**/shuffle_*_*_*.data", recursive=True))
print("left", len(after - before))
"""
    import os
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path)], capture_output=True, text=True, timeout=120, cwd=root)
    assert "left 0" in done.stdout, done.stdout + done.stderr[-2000:]


def test_texts_meet_their_digests_once(spark, monkeypatch):
    """What reads the different texts reads a written table; the join with all digests is not planned again."""
    plans = []
    made = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda d, *a, **k: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or made(d, *a, **k))
    texts = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z u v w"), (3, "x y z u v w")]
    kept = simhash.drop_near_copies(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert plans and not any("Join" in p for p in plans)


def test_pipeline_stages_bound_their_batches(spark):
    import corpus_pipeline
    from flowloom.llm.common import ARROW_ROWS
    before = spark.conf.get(ARROW_ROWS)
    for name, stage in corpus_pipeline.STAGES:
        if name == "pii":
            continue  # runs no Python
        spark.conf.set(ARROW_ROWS, "10000")
        stage(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0), "/root/testdata/sf0.001")
        assert int(spark.conf.get(ARROW_ROWS)) <= corpus_pipeline.ROWS
    spark.conf.set(ARROW_ROWS, before)


def test_packing_task_leaves_no_words_behind(spark):
    """Workers outlive their tasks: the words one has met are gone when it ends."""
    from flowloom.llm import common

    def held(batches):
        from flowloom.llm import packing as there
        for batch in batches:
            words = there.word_ids(there.tokenizer_path("word_bpe_49k.json"))
            yield batch.from_pydict({"n": [len(words.known)]})

    docs = frame(spark, odd_texts(3, 60)).coalesce(1)
    assert packing.pieces(docs, 2048).count() >= 60
    assert common.map_batches(spark.range(1).coalesce(1), held, "n long").first().n == 0


def test_a_cloud_of_copies_makes_few_pairs(spark, monkeypatch):
    """Nodes of crowded balls meet in tiles: the pairs that become rows grow no faster than the texts, no link is lost."""
    monkeypatch.setattr(simhash, "CROWD", 24)
    monkeypatch.setattr(simhash, "TILE", 40)
    made, rows = simhash._maybe, []
    monkeypatch.setattr(simhash, "_maybe", lambda pairs, *a: rows.append(pairs.count()) or made(pairs, *a))
    r = random.Random(31)
    base, texts = ["w%d" % i for i in range(150)], []
    for _ in range(240):  # up to ten words differ, so many are like few others and some like none
        w = list(base)
        for at in r.sample(range(150), r.randint(1, 10)):
            w[at] = "z%d" % r.randrange(10**6)
        texts.append(" ".join(w))
    got = {x.doc_id: x.component_id for x in simhash.near_copies(frame(spark, texts)).collect()}
    want = brute_groups(texts)
    assert len(set(want.values())) > 20 and got == want
    assert sum(rows) <= 10 * len(texts)


def test_tiles_link_what_is_similar_once():
    import pyarrow as pa
    # 0 and 1 are in one tile, and what joins 2 to one of them joins it to both.
    sets = [range(0, 100), range(5, 105), range(10, 110), range(500, 600), range(505, 605)]
    columns = {"node": range(5), "_of": range(5), "_size": [100] * 5, "_pos": [0] * 5, "_mine": [0, 0, 1, 0, 1]}
    table = {k: pa.array(list(v), pa.int64()) for k, v in columns.items()}
    table |= {"_left": pa.array([True] * 5), "_right": pa.array([True] * 5)}
    table |= {"shingles": pa.array([simhash.packed_set(np.array(s, np.uint64)) for s in sets])}
    links = [simhash._tile_links(0.8, inside)(pa.table(table)).to_pydict() for inside in (True, False)]
    assert links == [{"a": [0], "b": [1]}, {"a": [0, 1, 3], "b": [2, 2, 4]}]


def test_marks_and_commas_keep_the_ids_of_the_library():
    from tokenizers import Tokenizer
    import pyarrow as pa
    path = packing.tokenizer_path("word_bpe_49k.json")
    words, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    texts = EDGE + [".", ",", "a.", "A., b", "\u00e9, e\u0301. 1,2, 3.", "x<|endoftext|>, Y.", " , \n,", "\u00a0 \u00a0, \u3000", "z" * 50 + ", " + "q" * 45 + "."] + odd_texts(8)
    for _ in range(2):  # all new, then all known but the long ones
        got = words.encode(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
        assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    # A letter's mark is a word of its own, so a word is known once whatever ends it.
    words.forget()
    words.encode(pa.array([b"then then, then. Then, then."], pa.binary()))
    assert set(words.known) == {b"then", b",", b"."} and len(words.ids) == 3


def test_balls_of_the_same_texts_are_one(spark):
    balls = {1: "ab", 2: "ab", 3: "ab", 4: "abc", 5: "c", 6: "bca", 7: "ac"}
    rows = [(b, ord(n), 10 * ord(n), b + (n == "b")) for b, ns in balls.items() for n in ns]
    met = simhash._shared(spark.createDataFrame(rows + rows[:2], "_ball long, node long, _size int, _pos int"))
    got = {}
    for r in met.collect():
        got.setdefault(r._ball, []).append((chr(r.node), r._size, r._pos))
    # Ball 1 has repeated rows, so it may stand apart from 2 and 3; places are the first of each node.
    assert sorted(sorted(g) for g in got.values()) == [
        [("a", 970, 1), ("b", 980, 2)], [("a", 970, 2), ("b", 980, 3)], [("a", 970, 4), ("b", 980, 5), ("c", 990, 4)], [("a", 970, 7), ("c", 990, 7)]]


def test_tiles_shuffle_the_sets_of_their_nodes_only(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 4)
    plans = []
    made = simhash.cut_lineage
    monkeypatch.setattr(simhash, "cut_lineage", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or made(d))
    sets = {n: range(1000 * n, 1000 * n + 100) for n in range(1, 12)}
    sets |= {n + 20: range(1000 * n + 5, 1000 * n + 105) for n in range(1, 12)}
    met = spark.createDataFrame([(7, n, 100, 0) for n in sets], "_ball long, node long, _size int, _pos int")
    rows = [(n, len(s), bytearray(simhash.sketch(np.array(s, np.uint64))), bytearray(simhash.packed_set(np.array(s, np.uint64)))) for n, s in sets.items()]
    found = simhash.link_balls(met, spark.createDataFrame(rows, "node long, size long, sketch binary, shingles binary"), 0.8)
    assert {(r.a % 20, r.b % 20) for r in found.collect()} == {(n, n) for n in range(1, 12)}
    tiles = [p for p in plans if "FlatMapGroupsInArrow" in p]
    assert tiles and all("LeftSemi" in p for p in tiles)


def test_anchors_without_a_partner_leave_before_runs_are_counted(spark, monkeypatch):
    sizes = []
    made = suffixes.cut_lineage

    def counted(df):
        done = made(df)
        if {"core", "whole", "at"} <= set(done.columns):
            sizes.append(done.count())
        return done

    monkeypatch.setattr(suffixes, "cut_lineage", counted)
    r = random.Random(77)
    texts = ["".join(r.choice("abcdefgh") for _ in range(6000)) for _ in range(12)]
    texts[3] = texts[3][:2000] + texts[8][500:1100] + texts[3][2000:]
    got = {x.doc_id: x.n_removed for x in suffixes.cut_repeats(frame(spark, texts)).collect()}
    assert {k for k, n in got.items() if n} == {3, 8} and got[3] == got[8] >= 600
    assert len(sizes) == 2 and 0 < sizes[1] < sizes[0] / 10


def test_texts_with_a_common_passage_do_not_send_their_sets(spark, monkeypatch):
    """Of a crowded ball only nodes whose sketch leaves a chance are compared by their sets."""
    monkeypatch.setattr(simhash, "CROWD", 24)
    made, tiles = simhash._tile_links, []
    monkeypatch.setattr(simhash, "_tile_links", lambda *a: tiles.append(a) or made(*a))
    paired, pairs = simhash._maybe, []
    monkeypatch.setattr(simhash, "_maybe", lambda p, *a: pairs.append(p.count()) or paired(p, *a))
    pool = np.unique(np.random.default_rng(6).integers(0, 2**63, 9000, np.int64)).astype(np.uint64)
    sets = {n: np.r_[pool[:30], pool[100 * n + 30:100 * n + 100 + n % 9]] for n in range(60)}
    sets[60] = np.r_[sets[41][:-8], pool[8000:8008]]
    # Node 60 is the last one, so no ball's smallest node meets it.
    met = spark.createDataFrame([(7, n, len(s), 0) for n, s in sets.items()], "_ball long, node long, _size int, _pos int")
    rows = [(n, len(s), bytearray(simhash.sketch(s)), bytearray(simhash.packed_set(s))) for n, s in sets.items()]
    found = simhash.link_balls(met, spark.createDataFrame(rows, "node long, size long, sketch binary, shingles binary"), 0.8)
    assert [(r.a, r.b) for r in found.collect()] == [(41, 60)]
    assert not tiles and sum(pairs) < 130


@pytest.mark.parametrize("rows_at_once", [2_000_000, 300])
def test_model_of_all_characters_by_hand(spark, monkeypatch, rows_at_once):
    """Every character is a symbol and a context of its own, also if the model is read in parts."""
    from flowloom.llm import ngrams
    monkeypatch.setattr(ngrams, "ROWS_AT_ONCE", rows_at_once)
    r = random.Random(11)
    letters = [chr(0x4E00 + i) for i in range(120)] + list("abcDE \U0001F600")
    follows = {c: r.sample(letters, 3) for c in letters}  # what comes next depends on the character, not on its class

    def write(n):
        out = [r.choice(letters)]
        while len(out) < n:
            out.append(r.choice(follows[out[-1]]))
        return "".join(out)

    good = [write(r.randint(1, 200)) for _ in range(50)]
    junk = ["".join(r.choice(letters) for _ in range(200)) for _ in range(5)]  # the same characters in any order
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    docs = frame(spark, good + junk + ["Ж" * 30, None])
    judged = perplexity.judge(docs, labels)
    assert judged.columns.index("text_perplexity")
    got = {x.doc_id: x for x in judged.collect()}
    p = kneser_ney_by_hand([list("   " + t) for t in good[:40]], symbols=0x110000)
    for i, t in enumerate(good + junk):
        logs = [np.log(p(tuple(("   " + t)[k:k + 3]), c)) for k, c in enumerate(t)]
        assert got[i].text_perplexity == pytest.approx(np.exp(-np.mean(logs)), rel=1e-3)
    assert {i for i in got if got[i].kept} == set(range(50)) and got[56].text_perplexity is None


def test_different_grams_of_any_alphabet():
    from flowloom.llm import ngrams
    rng = np.random.default_rng(3)
    context, x = rng.integers(0, 1 << 63, 500, np.int64), rng.integers(1, 1 << 20, 500, np.int64)
    context, x = np.r_[context, context], np.r_[x, x]
    for base, keep in ((1 << 21, ngrams.LOW), (400, 255)):  # with numbers too large for one integer, and small ones
        some = sum((context >> k * ngrams.BITS & keep) << k * ngrams.BITS for k in range(3))
        at, last, which = ngrams.distinct(some, x & keep, base)
        assert len(at) == len(set(zip(some.tolist(), (x & keep).tolist()))) and (at[which] == some).all() and (last[which] == x & keep).all()
