"""The ten operators against brute force, held-out accuracy and round trips, and on the awkward tables that each must take."""

import base64
import hashlib
import random
import zlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillflow.llm import decontam, html_text, mixing, neighbours, passages, ppm, quality, queries, simhash, token_counts, warc
from quillflow.llm.components import connected_components

EXTRA = "size int, target string, n_words int, fp string, spans string, score string, learn string, edits string, stats string, h string"
DOC = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def words(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties, repeated rows, columns with clashing names."""
    long = words(60_000, 1)
    rows = [(1, words(80, 2), "en", "a"), (2, words(80, 2), "en", None), (2, words(80, 2), "en", None), (None, None, None, None), (None, "x y z", None, "a"), (3, "", "en", "b"), (4, " \n\t ", "de", "b"), (5, long, "en", "a"), (6, "Ünïcode ÀÉ ñ 日本 word", "fr", "c"), (7, None, "en", ""), (5, "other text", "en", "c")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, "t", 2, "f", "s", "q", "l", "e", "st", "hh") for r in rows], DOC).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1)):
    """Targets by repeated sharing of what the caps leave."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), float(sum(sizes.values())), set(order)
    while open_ and left > 1e-9:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if target[s] + level * w[s] >= 3 * sizes[s]}
        for s in full or open_:
            new = 3 * sizes[s] if full else target[s] + level * w[s]
            left -= new - target[s]
            target[s] = new
        if not full:
            break
        open_ -= full
    return target


def test_mixing_meets_its_targets(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        b = by.setdefault(r["source"], [0, 0, r["target"], 0])
        b[0] += r["size"]
        b[1] += r["taken"]
        b[3] = max(b[3], r["size"])
    want = water({s: b[0] for s, b in by.items()})
    for s, (_, taken, target, most) in by.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= most + 1
    assert abs(sum(b[1] for b in by.values()) - sum(b[0] for b in by.values())) <= max(b[3] for b in by.values())
    assert sorted(rows, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)


def test_mixing_odd_tables(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(empty).count() == 0
    size = {(r["doc_id"], r["source"]): r["size"] for r in rows}
    assert size[(None, None)] == 0 and size[(4, "b")] == 0 and size[(6, "c")] == 5
    assert len({r["taken"] for r in rows if r["doc_id"] == 2}) == 1


def test_targets_stop_at_three_times_the_size(spark):
    s = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(s).collect()}
    want = water({"a": 10, "b": 1000, None: 1000})
    assert got["a"] == 30 and all(got[k] == pytest.approx(want[k]) for k in want)


# 2 ---------------------------------------------------------------------------------------------------------------


def test_edits_count_like_a_full_encoding():
    enc = token_counts.encoder(token_counts.VOCABULARY)
    count = lambda t: len(enc.encode_ordinary(t))
    rnd = random.Random(3)
    for k in range(60):
        text = words(rnd.randint(0, 300), k) if k % 3 else "".join(rnd.choice("ab  \n'.é1") for _ in range(rnd.randint(0, 500)))
        tree = token_counts.SegmentTree(text, count, 64)
        for _ in range(5):
            pos, removed, added = rnd.randint(0, len(text) + 3), rnd.choice([0, 1, 30, 400]), rnd.choice(["", " x", "'s", "\n\n ", words(60, k)])
            tree.edit(pos, removed, added)
            pos = min(pos, len(text))
            text = text[:pos] + added + text[pos + removed :]
            assert (tree.text(), tree.n_tokens, tree.n_chars) == (text, count(text), len(text))


def test_edits_reencode_little(odd, empty, spark):
    rows = queries.op2_token_counts(spark, "/root/testdata/sf0.01").collect()
    big = [r for r in rows if r["n_chars"] > 20_000]
    assert big and all(r["reencoded_chars"] < 8_000 for r in big)
    enc = token_counts.encoder(token_counts.VOCABULARY)
    got = token_counts.count_with_edits(odd, token_counts.sample_edits(F.col("doc_id"), F.col("text"))).collect()
    assert sorted(r["n_tokens"] for r in got) == sorted(len(enc.encode_ordinary(t or "")) for _, t in texts(odd))
    assert token_counts.count_with_edits(empty, token_counts.sample_edits(F.col("doc_id"), F.col("text"))).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------


def brute_ppm(train, text, order):
    """The model's definition, symbol by symbol with dictionaries."""
    counts = [{} for _ in range(order + 1)]
    pad = lambda t: b"\xfe" * order + b" ".join(t) + b"\xff"
    for t in train:
        data = pad(t)
        for i in range(order, len(data)):
            for k in range(order + 1):
                c = counts[k].setdefault(data[i - k : i], {})
                c[data[i]] = c.get(data[i], 0) + 1
    total, data = 0.0, pad(text)
    for i in range(order, len(data)):
        refused: set = set()
        for k in range(order, -1, -1):
            c = {s: n for s, n in counts[k].get(data[i - k : i], {}).items() if s not in refused}
            if not c:
                continue
            whole = sum(c.values())
            if data[i] in c:
                total += np.log10((c[data[i]] - 0.5) / whole)
                break
            total += np.log10(0.5 * len(c) / whole)
            refused |= set(c)
        else:
            total -= np.log10(256 - len(refused))
    return total


def test_ppm_equals_its_definition():
    train = [ppm.tokens(words(40, k).encode()) for k in range(6)]
    keys, _ = ppm.gram_keys(train, 3)
    u, n = np.unique(keys, return_counts=True)
    trie = ppm.Trie(u, n, ppm._grouped(u & np.uint64(0xFFFF), n), 3)
    for t in (b"", b"ab cd", words(20, 99).encode(), "ünï zz".encode()):
        got = trie.log10(ppm.gram_keys([ppm.tokens(t)], 3)[0]).sum()
        assert got == pytest.approx(brute_ppm(train, ppm.tokens(t), 3), rel=1e-9)


def test_ppm_probabilities_sum_to_one():
    train = [ppm.tokens(words(30, k).encode()) for k in range(4)]
    u, n = np.unique(ppm.gram_keys(train, 3)[0], return_counts=True)
    trie = ppm.Trie(u, n, ppm._grouped(u & np.uint64(0xFFFF), n), 3)
    for ctx in (b"abc", b"zzz", b" ab", b"\xfe\xfe\xfe"):
        base = int.from_bytes(ctx, "big") << 8
        assert (10 ** trie.log10(np.array([base | s for s in range(256)], np.uint64))).sum() == pytest.approx(1)


def test_ppm_contract_and_blocks(docs, odd, empty):
    learn = queries.crc_mod(7) != 2
    one = {r["doc_id"]: r for r in ppm.score(docs, learn).collect()}
    many = {r["doc_id"]: r for r in ppm.score(docs, learn, gram_block=20_000, word_block=5_000).collect()}
    counts: dict = {}
    for i, t in texts(docs):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), "end"]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in texts(docs):
        toks = [*re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()), "end"]
        r = one[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(toks), sum(w in counts for w in toks), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in toks))
        assert many[i]["score"] == pytest.approx(r["score"]) and many[i]["n_known"] == r["n_known"]
    for kw in ({}, {"gram_block": 500, "word_block": 500}):
        got = ppm.score(odd, learn, **kw).collect()
        assert len(got) == odd.count() and all(r["score"] < 0 for r in got)
        assert sorted(r["n_tokens"] for r in got) == sorted(1 + len((t or "").encode().split()) for _, t in texts(odd))
    assert ppm.score(empty, learn).count() == 0
    assert ppm.score(odd, F.lit(False)).where("train_tokens = 0 AND n_known = 0 AND base_score = 0").count() == odd.count()


# 4 ---------------------------------------------------------------------------------------------------------------


def brute_near(ids, x, q, k):
    s = (x * x[q]).sum(axis=1)
    return [int(ids[j]) for j in np.lexsort((ids, -s)) if j != q][:k]


def test_neighbours_recall_and_scores(spark, sf):
    rows = queries.op4_neighbours(spark, sf).collect()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in e]), np.array([r["embedding"] for r in e], float)
    found: dict = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["score"] == pytest.approx(float(x[list(ids).index(r["vec_id"])] @ x[list(ids).index(r["query_id"])]), abs=1e-12)
    qs = [i for i, v in enumerate(ids) if v % 20 == 0]
    assert set(found) == {int(ids[q]) for q in qs} and all(len(v) == 20 for v in found.values())
    hits = sum(len(set(found[int(ids[q])]) & set(brute_near(ids, x, q, 20))) for q in qs)
    assert hits / (20 * len(qs)) >= 0.9


def test_multi_index_finds_all_within_a_radius():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    index = neighbours.MultiIndex(np.arange(3000), rng.normal(size=(3000, 4)), codes, 64)
    for radius in (0, 3, 20, 27):
        for c in codes[:5]:
            assert list(index.within(c, radius)) == list(np.flatnonzero(np.bitwise_count(codes ^ c) <= radius))


def test_neighbours_odd_tables(spark):
    schema = "vec_id bigint, embedding array<float>, label int, score double, rank int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, []), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 1.0, 1) for r in rows], schema)
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.op_rows(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0), (20, 3, 2, 0.0)]
    assert neighbours.op_rows(spark.createDataFrame([], schema)).count() == 0


# 5 ---------------------------------------------------------------------------------------------------------------


def brute_hits(docs, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows: dict = {}
    for i, t in items:
        w = find(t)
        for k in range(max(0, len(w) - 9) if len(w) >= 10 else bool(w)):
            windows.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, got = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    got |= s
                    hit |= set(range(k, k + n))
        out.append((d, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


FIELDS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("listed", [50_000, 0])
def test_decontamination_equals_brute_force(spark, docs, sf, odd, empty, monkeypatch, listed):
    plain = decontam.find_matches
    monkeypatch.setattr(decontam, "find_matches", lambda d, s: plain(d, s, listed))
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    short = spark.createDataFrame([(900, "The"), (901, "of and"), (902, words(80, 2)[:60]), (903, "x, Y z"), (904, ""), (905, None), (None, "x y"), (900, "The"), (906, "the"), (907, words(80, 2))], "item_id bigint, text string")
    both = items.select("item_id", "text").union(short)
    have = [(r["item_id"], r["text"]) for r in both.collect() if r["item_id"] is not None]
    for table in (docs.limit(60), odd):
        got = [tuple(r[c] for c in FIELDS) for r in decontam.decontaminate(table, both).collect()]
        assert sorted(got, key=str) == brute_hits(texts(table), have)
    assert decontam.decontaminate(empty, both).count() == 0
    none = decontam.decontaminate(odd, both.limit(0)).collect()
    assert len(none) == odd.count() and not any(r["contaminated"] for r in none)
    kept = decontam.drop_contaminated(odd, both)
    clean = [r for r in brute_hits(texts(odd), have) if not r[5]]
    assert kept.columns == odd.columns and kept.count() == len(clean)


# 6 ---------------------------------------------------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op6_quality(spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(got[i]["predicted"], q) for i, q in labels if got[i]["held_out"]]
    assert held and sum(p == q for p, q in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_compressibility_is_that_of_the_whole_text():
    opening = words(20_000, 6).encode()[: 1 << 16]
    rest = b"same line\n" * 50_000
    n = len(opening) + len(rest)
    got = [quality.document_stats(x)[20] for x in (opening, opening + rest)]
    assert got[0] == len(zlib.compress(opening, 1)) / len(opening)
    assert abs(got[1] - len(zlib.compress(opening + rest, 1)) / n) < 1e-3 and got[1] < got[0] / 3
    assert quality.compressed_size(b"short text") == len(zlib.compress(b"short text", 1))


def test_quality_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1), (5, None, 0), (None, 1, 0), (3, 0, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        rows = quality.classify(odd, lab, F.lit(True)).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.classify(empty, labels, F.lit(True)).count() == 0
    assert quality.keep_good(odd, labels, F.lit(True)).columns == odd.columns


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    c = rng.integers(1, 9, 50).astype(float)
    t = rng.random(50) * c
    v = quality.isotonic(t, c)
    assert (np.diff(v) >= -1e-12).all() and (v * c).sum() == pytest.approx(t.sum())


# 7 ---------------------------------------------------------------------------------------------------------------


def brute_components(rows):
    """rows: (doc_id, fp); components under 4 bits by pairs."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f, least.get(find(i))) for i, (d, f) in enumerate(rows)]


def slow_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash_equals_brute_force(docs, odd, empty):
    for table in (docs, odd):
        rows = [(d, slow_fingerprint(t)) for d, t in texts(table)]
        got = [(r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(table).collect()]
        assert sorted(got, key=str) == sorted(brute_components(rows), key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_anchors_find_every_pair_within_the_threshold(spark):
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in list(fps):
        for bits in (1, 2, 3, 4, 5):
            g = f
            for b in rng.sample(range(64), bits):
                g ^= 1 << b
            fps.append(g)
    fps = list(dict.fromkeys(fps))
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    want = {d: c for d, _, c in brute_components([(signed(f), f) for f in fps])}
    for tile in (4096, 3):  # also with anchors split in tiles
        got = {r["node"]: r["root"] for r in connected_components(simhash.fingerprint_links(df, tile)).collect()}
        assert {d: got.get(d, d) for d in want} == want


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(900, 901), (902, 902)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[901] == 900 and 902 not in got


def test_keep_first_leaves_one_of_each_component(docs, odd):
    kept = simhash.keep_first(docs)
    comps = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(comps) and kept.columns == docs.columns
    rest = simhash.keep_first(odd)
    assert rest.columns == odd.columns and rest.where("doc_id = 2").count() == 0 and rest.where("doc_id = 1").count() == 1


# 8 ---------------------------------------------------------------------------------------------------------------


def brute_windows(h, t):
    """Centres of the Cartesian tree whose range has t elements or more, with the range."""
    out = set()

    def walk(a, b):
        if b - a >= t:
            c = min(range(a, b), key=lambda i: (h[i], i))
            out.add((a, c, b - 1))
            walk(a, c), walk(c + 1, b)

    walk(0, len(h))
    return out


def test_compact_windows_are_the_tree():
    rng = np.random.default_rng(8)
    parts = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (10, 46, 200, 3, 77)]
    starts = np.cumsum([0, *map(len, parts)])
    v, d, lo, c, r = passages.compact_windows(np.concatenate(parts), starts, 46, 1)
    for k, p in enumerate(parts):
        got = {(a, b, e) for x, a, b, e in zip(d.tolist(), lo.tolist(), c.tolist(), r.tolist()) if x == k}
        assert got == brute_windows(passages._function(p, 1), 46)


def planted(spark):
    shared = words(70, 50).split()
    near = list(shared)
    near[35] = "changedword"
    far = [w if i % 6 else "other" + str(i) for i, w in enumerate(shared)]
    put = lambda seed, mid: " ".join([*words(90, seed).split(), *mid, *words(40, seed + 500).split()])
    rows = [(10, put(1, shared)), (11, put(2, shared)), (12, put(3, near)), (13, put(4, far)), (14, put(5, shared[:40])), (15, words(300, 6)), (16, put(7, shared)), (11, put(2, shared))]
    return spark.createDataFrame([(*r, "en", "a", len(r[1])) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint"), " ".join(shared)


def test_passages_that_repeat_are_found(spark):
    df, shared = planted(spark)
    got = {r["doc_id"]: r for r in passages.mark_repeats(df).collect()}
    for i in (11, 16):
        assert got[i]["n_dup_words"] == 70 and [(x["s"], x["e"], x["ref_id"]) for x in got[i]["spans"]] == [(90, 160, 10)]
    assert got[12]["n_dup_words"] >= 60 and all(got[i]["n_dup_words"] == 0 for i in (10, 13, 14, 15))
    out = passages.remove_repeats(df)
    after = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == df.count() and out.columns == df.columns
    assert shared in after[10]["text"] and all(shared not in after[i]["text"] for i in (11, 12, 16))
    assert after[11]["n_chars"] == len(after[11]["text"]) and after[15]["text"] == words(300, 6)


def marked(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return {r["doc_id"]: [(x["s"], x["e"], x["ref_id"]) for x in r["spans"]] for r in passages.mark_repeats(df).collect()}


def pieces(passage, seed):
    """Parts of a passage, each too short to be a repeat, that together hold all its shingles."""
    w = passage.split()
    return " ".join(" ".join([*w[a : a + 30], words(40, seed + a)]) for a in range(0, len(w) - 5, 20))


def test_passages_at_a_later_place_of_the_first_document(spark):
    rows = []
    for i in range(0, 40, 2):
        shared = words(60, 900 + i)
        rows += [(i, " ".join([words(40, 1000 + i), pieces(shared, 5000 + 100 * i), shared, words(40, 2000 + i)])), (i + 1, " ".join([words(45, 3000 + i), shared, words(45, 4000 + i)]))]
    got = marked(spark, rows)
    assert all(got[i + 1] == [(45, 105, i)] for i in range(0, 40, 2))


def test_passages_whose_values_an_earlier_document_holds(spark):
    passage = {i: words(60, 900 + i) for i in range(20)}
    rows = [(i, " ".join([words(40, 1000 + i), pieces(x, 5000 + 100 * i)])) for i, x in passage.items()]
    rows += [(100 + 100 * k + i, " ".join([words(45, 7000 + 100 * k + i), x, words(45, 8000 + 100 * k + i)])) for i, x in passage.items() for k in range(2)]
    got = marked(spark, rows)
    assert all(got[i] == got[100 + i] == [] for i in passage)
    # the reach of a window can end a few words before the passage does
    assert all({x[2] for x in got[200 + i]} == {100 + i} and max(e for _, e, _ in got[200 + i]) - min(s for s, _, _ in got[200 + i]) >= 50 for i in passage)


def test_windows_with_one_changed_word_share_two_minima():
    missed, n = 0, 2000
    rng = np.random.default_rng(4)
    for _ in range(n):
        a, b = rng.integers(0, 2**63, (2, passages.MIN_WINDOW), dtype=np.uint64)
        b[:20], b[25:] = a[:20], a[25:]  # Jaccard 41 / 51
        missed += sum(passages._function(a, f).min() == passages._function(b, f).min() for f in range(passages.N_HASHES)) < passages.MIN_HASHES
    assert missed < n / 500


def test_passages_odd_tables(odd, empty):
    rows = passages.mark_repeats(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r["n_dup_words"] for r in rows if r["doc_id"] == 2) == [80, 80]
    assert passages.mark_repeats(empty).count() == 0 and passages.remove_repeats(empty).count() == 0
    left = passages.remove_repeats(odd)
    assert left.where("doc_id = 2").count() == 0 and left.where("doc_id = 1").count() == 1 and left.columns == odd.columns


# 9 ---------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body class="ad-free">
<header><h2>Site name</h2></header><nav class=menu><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav>
<div class="cookie-notice">We use cookies on this site for many reasons.</div><!-- comment -->
<%s><h1>The  title &amp; more</h1><p>First paragraph with <b>bold</b> words,<br>a break&nbsp;and enough text to be an article.<p>Second one is short.
<aside>Read also: something else entirely, which is not a part of the article.</aside><form><input value=x>Name <button>Go</button></form>
<ul><li>item one of the list<li>item two of the list</ul><p>Last paragraph of the article with some more words in it.</p></%s>
<section id="comments"><p>Great article, I liked it so much that I write a long comment under it.</p></section>
<div class="sidebar widget">Side text</div><footer>&copy; 2024</footer></body></html>"""
WANT = "The title & more\nFirst paragraph with bold words, a break and enough text to be an article.\nSecond one is short.\nitem one of the list\nitem two of the list\nLast paragraph of the article with some more words in it."


@pytest.mark.parametrize("tag", ["article", "div", "main"])
def test_main_text(tag):
    assert html_text.main_text(PAGE % (tag, tag)) == WANT


def test_pages_of_the_test_data(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op9_html(spark, sf).collect():
        body = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]+>", " ", body)
        import html

        assert html.unescape(plain).split() == r["text"].split() and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>a<b>b</p>"), (3, "u", "no tags at all"), (4, "u", "<" * 50), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (5, "u", "<script>x"), (6, "u", "<article>" + "<p>word word</p>" * 20000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    got = [(r["page_id"], r["text"]) for r in html_text.extract(df).collect()]
    assert len(got) == len(rows) and (1, "") in got and (2, "") in got and (3, "no tags at all") in got and (5, "deep") in got
    assert len(dict(got)[6].split("\n")) == 20000
    assert html_text.extract(df.limit(0)).count() == 0


# 10 --------------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (3, "u\r\nX: y", "Ünïcode"), (4, "u", None), (5, "u", ""), (None, "u", "same"), (9, None, "same"), (6, "u", "WARC/1.0\r\n\r\n" * 5), (7, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id bigint, url string, html string, sha string, n int")
    folder = str(tmp_path / "w")
    warc.write_archives(warc.plan_records(df), folder)
    got = warc.read_archives(spark, folder).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = []
    for i, _, t in rows:
        last = max((j for j, _, x in rows if (x or "") == (t or "") and j is not None), default=None)
        want.append((i, len((t or "").encode()), digest(t), "response" if i == last else "revisit", None if i == last else last))
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(want, key=str)
    assert warc.read_archives(spark, folder, gaps=True).count() == 0
    warc.write_archives(warc.plan_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(packed):
    one = [warc.build_record(i, f"http://x/{i}", b"payload %d " % i * 40) for i in range(6)]
    one = [warc.gzip_member(r) for r in one] if packed else one
    data = bytearray(b"".join(one))
    start = len(one[0]) + len(one[1])
    data[start + len(one[2]) // 2] ^= 0xFF
    records, gaps = warc.salvage(bytes(data))
    assert [r["page_id"] for r in records] == [0, 1, 3, 4, 5]
    assert [(a, b) for a, b, _ in gaps] == [(start, start + len(one[2]))]
    records, gaps = warc.salvage(bytes(data[: len(data) - 10]) + b"junk")
    assert [r["page_id"] for r in records] == [0, 1, 3, 4] and len(gaps) == 2
    assert warc.salvage(b"") == ([], []) and warc.salvage(b"nothing")[0] == []


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now and now <= seen
        seen = now
        if k < 4:
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()) == sorted(seen)


def test_salvage_inside_members():
    """Several records in one member: a bad one, or a break of the stream, costs only itself."""
    recs = [warc.build_record(i, f"http://x/{i}", bytes([97 + i]) * 500 + words(200, i).encode()) for i in range(6)]
    bad = [*recs]
    bad[2] = bad[2].replace(b"c" * 500, b"c" * 499 + b"X")
    found, gaps = warc.salvage(warc.gzip_member(b"".join(bad)))
    assert [r["page_id"] for r in found] == [0, 1, 3, 4, 5] and [g[2] for g in gaps] == ["block digest differs"]
    stream = warc.gzip_member(b"".join(recs))
    found, gaps = warc.salvage(stream[: int(len(stream) * 0.8)])
    assert [r["page_id"] for r in found] == list(range(len(found))) and len(found) >= 3 and len(gaps) == 1 and gaps[0][1] == int(len(stream) * 0.8)


def test_archives_of_other_attempts_are_not_read(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>b</p>")], "page_id bigint, url string, html string")
    written = warc.write_archives(warc.plan_records(pages), str(tmp_path))
    (tmp_path / "pages-000000-0000-stale.warc.gz").write_bytes(warc.gzip_member(warc.build_record(1, "u", b"old")))
    assert sorted(r["page_id"] for r in warc.read_archives(spark, str(tmp_path), written=written).collect()) == [1, 2]


def test_repeated_query_ids_ask_by_their_first_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(60)] + [(20, rng.normal(size=8).tolist())]
    get = lambda x: sorted(map(tuple, neighbours.op_rows(spark.createDataFrame(x, "vec_id bigint, embedding array<double>")).collect()))
    assert get(rows) == get(rows[::-1])


def test_frequent_values_lose_no_exact_repeat(spark):
    """A line of 20 words that all documents hold, each elsewhere, inside passages that pairs of documents share."""
    line, rows = words(20, 77), []
    for i in range(60):
        shared = " ".join([words(20, 100 + i), line, words(20, 200 + i)])
        rows += [(2 * i, " ".join([words(30, 1000 + i), line, words(30, 2000 + i), shared, words(30, 3000 + i)])), (2 * i + 1, " ".join([words(30, 4000 + i), shared, words(30, 5000 + i)]))]
    got = marked(spark, rows)
    assert all(min(s for s, _, _ in got[2 * i + 1]) <= 30 and max(e for _, e, _ in got[2 * i + 1]) >= 90 for i in range(60))


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    from quillflow.llm import common

    texts = [b"", None, b" A\tb \n", b"a B", b"ab", b"x" * 5000, "é É日".encode(), b"a b c d e f", b"A B c D e F"]
    h, n = common.word_hashes(pa.array(texts, pa.binary()))
    flat = [w for t in texts for w in (t or b"").lower().split()]
    assert n.tolist() == [len((t or b"").split()) for t in texts] and len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    s, k = common.rolled_shingles(h, n, 5)
    assert k.tolist() == [0, 0, 0, 0, 0, 0, 0, 2, 2] and s[:2].tolist() == s[2:].tolist()


def test_words_in_names_do_not_drop_article_text():
    long = lambda i: words(40, i)
    page = f"""<html><body><nav>menu</nav><article><p>{long(1)}</p><section id="related-work"><p>{long(2)}</p></section><p class="notice-board">{long(3)}</p>
<p>a <span class="comment">b</span> <em class="ad">c</em> d {long(4)}</p><div class="notice">We use cookies on this page {long(5)}</div><div class="share-links"><a href="x">tweet</a><a href="y">mail</a></div><p>{long(6)}</p></article>
<div class="ad">buy {long(7)}</div></body></html>"""
    assert html_text.main_text(page) == "\n".join([long(1), long(2), long(3), f"a b c d {long(4)}", long(6)])
    bare = page.replace("<article>", "<div>").replace("</article>", "</div>")
    assert html_text.main_text(bare) == html_text.main_text(page)


def test_frequent_values_lose_no_near_repeat(spark):
    """One word of a passage changed in pairs of documents, that no other document repeats, while a hundred hold every part of it in shorter pieces."""
    passage = words(50, 321).split()

    def text(i, *changed):
        w = list(passage)
        for p in changed:
            w[p] = f"changed{i}"
        return " ".join([words(30, 10_000 + i), *w, words(30, 20_000 + i)])

    rows = [(i, text(i, *((2, 47) if i % 2 else (8, 41)))) for i in range(100)]
    rows += [(100 + 2 * k + j, text(100 + 2 * k + j, p)) for k, p in enumerate((20, 30, 25)) for j in (0, 1)]
    got = marked(spark, rows)
    assert all(got[i] == [] for i in range(100))
    for k in range(3):
        assert got[100 + 2 * k] == [] and {r for _, _, r in got[101 + 2 * k]} == {100 + 2 * k}
        assert min(s for s, _, _ in got[101 + 2 * k]) == 30 and max(e for _, e, _ in got[101 + 2 * k]) == 80


def test_places_around_a_shingle_equal_brute_force():
    rng = np.random.default_rng(6)
    x = rng.integers(1, 2**32, (80, 2 * passages.MIN_WINDOW - 1), dtype=np.uint32)
    x[:, 22:68] = x[0, 22:68]
    for i in range(80):
        p = int(rng.choice([*range(22, 41), *range(46, 64)]))
        x[i, p : p + 5] = rng.integers(1, 2**32, 5)
    want = {(i, k) for i in range(80) for j in range(i) for s, e in passages.repeated_runs(x[i], x[j]) for k in range(s, e)}
    got = {(i, k) for i, j, runs in passages.near_places(x, np.arange(80), np.ones(80, bool)) for s, e in runs for k in range(s, e)}
    assert want and got == want


def test_windows_and_links_move_in_few_blocks(spark):
    """Rows that Spark shuffles: at most one a task and bucket, not one a window or link; buckets fill the partitions evenly."""
    from pyspark.sql import functions as F

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for k in (1, n, 211):
        keys = passages._bucket_keys(k)
        got = spark.createDataFrame([(int(x),) for x in keys], "b int").select(F.pmod(F.hash("b"), F.lit(k)).alias("p")).collect()
        assert [r["p"] for r in got] == list(range(k))
    df = spark.createDataFrame([(i, words(300, i % 20)) for i in range(400)], "doc_id bigint, text string").repartition(2)
    keys = passages._bucket_keys(n)
    blocks = passages.document_windows(passages.keyed(df), keys)
    held = blocks.collect()
    assert len(held) <= 2 * n
    whole = np.concatenate([np.frombuffer(r["v"], np.int64) for r in held])
    want = [x for i in range(400) for f in range(passages.N_HASHES) for x in _values(words(300, i % 20), f)]
    assert sorted(whole.tolist()) == sorted(want)
    for r in held:
        assert len({int(b) for b in passages._value_bucket(np.frombuffer(r["v"], np.int64), n)}) == 1


def _values(text, f):
    import pyarrow as pa

    from quillflow.llm import common

    h, _ = common.rolled_shingles(*common.word_hashes(pa.array([text.encode()], pa.binary())), passages.SHINGLE)
    return passages.compact_windows(h, np.array([0, len(h)]), passages.MIN_WINDOW, f)[0].view(np.int64).tolist()


def test_id_buckets_agree_with_their_column(spark):
    ids = [0, 1, -1, 2**62 + 5, -(2**63), 2**63 - 1, *range(1000, 1100)]
    df = spark.createDataFrame([(i,) for i in ids], "_id bigint").select(passages._id_bucket_of("_id", 13).alias("b"))
    assert [r["b"] for r in df.collect()] == passages._id_bucket(np.array(ids, np.int64), 13).tolist()


def test_uncovered_places_equal_brute_force():
    rng = np.random.default_rng(3)
    ids, ks, place = rng.integers(-3, 3, 500), rng.integers(0, 2, 500), rng.integers(0, 200, 500)
    i, k, s = rng.integers(-3, 3, 20), rng.integers(0, 2, 20), rng.integers(0, 180, 20)
    e = s + rng.integers(1, 60, 20)
    want = [not any((a, b) == (c, d) and x <= p <= y - passages.SHINGLE for c, d, x, y in zip(i, k, s, e)) for a, b, p in zip(ids, ks, place)]
    assert passages.uncovered(ids, ks, place, (i, k, s, e)).tolist() == want and 0 < sum(want) < 500


def test_written_tables_leave_no_shuffle_files(spark, tmp_path):
    from quillflow.llm import common

    status = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = status.shuffleStatuses().size()
    table = common.materialize(spark.range(1000).repartition(7, "id"), "ids")
    assert status.shuffleStatuses().size() <= before and table.count() == 1000
    assert spark.conf.get(common.CLEANUP) == "false"


def test_word_counts_equal_split():
    import pyarrow as pa

    texts = [b"", None, b" A\tb \n", b"ab", b"c", b"  ", b"x y\x0bz\x1cq", "é 日 本".encode()]
    assert passages.word_counts(pa.array(texts, pa.binary())).tolist() == [len([w for w in re.split(rb"[\x20\x09-\x0D]+", t or b"") if w]) for t in texts]
    assert passages.word_counts(pa.array(texts, pa.binary()).slice(2, 3)).tolist() == [2, 1, 1]
