"""Operators against brute force, round trips and held-out labels, with nulls, empties, ties, repeats and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from folioforge.llm import bpe, licenses, packing, quality, sharding, simhash, topk, toxicity, urlfilter, warc
from folioforge.llm.common import connected_components, materialize

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fp long, key string, block int, rank int"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "\n", "a", "a  b", " lead", "trail ", "x\n\n y\t z\x0b\x0cq\x1cw\u00a0v\u2003u", "don't we'll I'm", "ß ΑΣ Σ İ é e\u0301", "日本語 テキスト", "<|endoftext|> <|startoftext|>", "  \n \n", "12345 6.7e8", "👩‍👩‍👧 ok", "a" * 3000, "word " * 5000, "\u0301x"]


def docs_of(spark, texts, start=0):
    rows = [(start + i, t, "en", "s", None, 1, "k", 2, 3) for i, t in enumerate(texts)]
    return materialize(spark.createDataFrame(rows, DOC), "docs")


def texts_of(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1400)] + [(5000, 6000 + k) for k in range(200)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups, ours = defaultdict(set), defaultdict(set)
    for x, label in got.items():
        ours[label].add(x)
    for x in parent:
        groups[find(x)].add(x)
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(g) for g in ours.values()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_of_hot_lists(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    near = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {(base & 0xFFFFFF) | (rng.getrandbits(40) << 24) for _ in range(400)}  # one triple alike
    fps |= {near(x, rng.randint(1, 5)) for x in list(fps)[:60]}
    fps |= {(base & 0xFFFFFFFF) | (rng.getrandbits(14) << 40) for _ in range(300)}  # four bytes alike, and more
    fps |= {(base & ~0xFFF) | rng.getrandbits(12) for _ in range(200)}
    rows = [(x - (1 << 64 if x >> 63 else 0),) for x in sorted(fps)]
    edges = simhash.links(spark.createDataFrame(rows, "fp long"), list_rows=8, hot_rows=24).collect()

    def parts(pairs):
        parent = {x: x for x in fps}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        out = defaultdict(set)
        for x in fps:
            out[find(x)].add(x)
        return set(map(frozenset, out.values()))

    assert parts((a % (1 << 64), b % (1 << 64)) for a, b in edges) == parts((a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4)


def test_hot_list_is_keyed_anew(spark):
    n = 100_000
    fps = spark.range(n).selectExpr("(xxhash64(id) & ~16777215L) | 77 AS fp").distinct()
    again = simhash._by_fourth(fps.selectExpr("0L AS key", "7 AS used", "fp"))
    assert again.count() <= 5 * n and again.groupBy("key").count().agg({"count": "max"}).first()[0] < 1000
    assert simhash.links(fps).count() >= 0


def test_covering_triples():
    triples = simhash.covering_triples()
    assert len(triples) == 20
    assert all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def plain_fingerprint(text, n):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    texts = texts_of(spark)[:120] + ODD + [None, "a"]
    rng = random.Random(1)
    base = (texts[0] * 3).split()
    for _ in range(60):  # a group of near copies
        w = list(base)
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", "zz"])
        texts.append(" ".join(w))
    want = [plain_fingerprint(t, 4) for t in texts]
    got = simhash.near_duplicates(docs_of(spark, texts, 10), list_rows=8).orderBy("doc_id").collect()
    assert [int(r.fingerprint, 16) for r in got] == want
    label = list(range(len(texts)))
    for _ in range(len(texts)):
        new = [min(label[j] for j in range(len(texts)) if (want[i] ^ want[j]).bit_count() <= 4) for i in range(len(texts))]
        if new == label:
            break
        label = new
    assert [r.component_id for r in got] == [10 + x for x in label]
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    null = spark.createDataFrame([(None, "q w e r t y"), (None, "q w e r t y"), (3, "other words here now ok")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(null).collect()) == [(0, 0), (0, 0), (3, 3)]


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_keep_one_of_similar_texts(spark):
    rng, vocabulary = random.Random(11), [f"w{i}" for i in range(900)]
    texts, origin = [], []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 400))]
        for edits in (0, 0, 1, 2, 3, 12):
            w = list(base)
            for _ in range(edits * len(w) // 200 + (edits > 0)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w))
            origin.append(k)
    same = [(i, j) for i in range(len(texts)) for j in range(i) if origin[i] == origin[j]]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(spark, texts), list_rows=4).collect()}
    close = [(i, j) for i, j in same if jaccard(texts[i], texts[j]) >= 0.8]
    assert len(close) > 100 and sum(found[i] == found[j] for i, j in close) / len(close) >= 0.95
    assert all(origin[i] == origin[c] for i, c in found.items())  # nothing of another origin
    kept = simhash.keep_one(docs_of(spark, texts))
    assert kept.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(found.values()))
    null = spark.createDataFrame([(None, "q w e r t y"), (None, "q w e r t y"), (3, "x y z"), (3, "x y z"), (4, None), (5, "")], "doc_id long, text string")
    assert sorted((r.doc_id or 0) for r in simhash.keep_one(null).collect()) == [0, 0, 3, 4]
    mixed = spark.createDataFrame([(1, "copy of the very same words here"), (2, "copy of the very same words here"), (2, "a text that nobody else has got"), (2, "a text that nobody else has got"), (2, "one more text of this id alone")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:6]) for r in simhash.keep_one(mixed).collect()) == [(1, "copy o"), (2, "a text"), (2, "one mo")]
    assert simhash.keep_one(null.limit(0)).count() == 0


def test_bpe(spark):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    texts = texts_of(spark) + ODD
    ids = bpe.encode(docs_of(spark, texts).repartition(3), path=RANKS, pattern=public_tokenizers.PATTERN, block_chars=20_000)
    got = {r.doc_id: (list(np.frombuffer(r.ids, "<u4")), bytes(r.decoded)) for r in bpe.decode(ids, path=RANKS).collect()}
    for k, t in enumerate(texts):
        assert got[k] == (own.encode_ordinary(t or ""), (t or "").encode()), (k, t)
    d = {r.doc_id: r for r in bpe.digests(ids, path=RANKS).collect()}
    assert d[0].decoded_sha256 == hashlib.sha256(texts[0].encode()).hexdigest() and d[0].n_tokens == len(got[0][0])
    assert bpe.encode(docs_of(spark, []), path=RANKS, pattern=public_tokenizers.PATTERN).count() == 0
    own = tiktoken.Encoding("other", pat_str=r"[a-z]|\s\S+", mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    some = ["abc def ghi", "a\x1cb  c\u2003d", None]
    ids = bpe.encode(docs_of(spark, some), path=RANKS, pattern=r"[a-z]|\s\S+").orderBy("doc_id").collect()
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in ids] == [own.encode_ordinary(t or "") for t in some]
    assert bpe.COMMON_PATTERN == public_tokenizers.PATTERN
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1])
    assert bpe.unpack_ints(bpe.pack_ints(v)).tolist() == v.tolist()


def test_packing(spark):
    t = Tokenizer.from_file(WORD_BPE)
    texts = texts_of(spark) + ODD
    docs = docs_of(spark, texts + texts[:5]).withColumn("length", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("x"))
    rows = packing.pack(docs, path=WORD_BPE, capacity=512, keep_ids=True).collect()
    want = {k: [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in enumerate(texts + texts[:5])}
    by = defaultdict(list)
    for r in rows:
        ids = list(np.frombuffer(r.ids, "<u4"))
        assert ids == want[r.doc_id][r.start : r.start + r.length] and r.start == 512 * r.piece
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    assert Counter(r.doc_id for r in rows) == {k: -(-len(v) // 512) for k, v in want.items()}
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 512
    assert len(by) <= 1.05 * sum(map(len, want.values())) / 512 + 1
    assert packing.pack(docs_of(spark, []), path=WORD_BPE).count() == 0
    parts = spark.createDataFrame([(3, 7, "r")] * 40 + [(2, 8, "s")] * 9, "length int, _key int, _rank string")
    placed = packing.assign(parts, capacity=10).collect()
    assert Counter((r.length, r._key, r._rank) for r in placed) == {(3, 7, "r"): 40, (2, 8, "s"): 9} and len({(r.sequence_id, r.offset) for r in placed}) == 49
    with pytest.raises(ValueError):
        packing.assign(parts.withColumnRenamed("_key", "Offset"), capacity=10)


def test_token_ids_of_odd_strings():
    rng, t = random.Random(4), Tokenizer.from_file(WORD_BPE)
    texts = ["hello <|endoftext|> bye", "ΣΑΣ ΣΑ. İ$ İ, Ångström क़. don't 's x's, ab''cd 12ab ½x é.É ≮ a≮", "w " * 3_000_000 + "end", *(x or "" for x in ODD)]
    texts += ["".join(rng.choice("aA.'s1 é\u0301Σ$ ,İ\u00ad\u200d’\t\u2003中\n") for _ in range(rng.randrange(40))) for _ in range(3000)]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.token_ids(pa.array(texts), WORD_BPE)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(20):
        cap = rng.choice([10, 64, 100])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 300)))
        bins = []
        for n in sorted(counts.elements(), reverse=True):
            fits = [k for k, room in enumerate(bins) if room >= n]
            if fits:
                bins[min(fits, key=lambda k: bins[k])] -= n
            else:
                bins.append(cap - n)
        runs = packing.plan(counts, cap)
        assert len({r[3] + i for r in runs for i in range(r[2] // r[4])}) == len(bins)
        assert Counter({n: sum(r[2] for r in runs if r[0] == n) for n in counts}) == counts


def test_sharding(spark):
    for n, parts in ((1003, 7), (5, 3), (0, 1)):
        df = spark.range(n).selectExpr("if(id % 9 = 0, null, id % 50) AS doc_id", "id AS _key2").repartition(parts)
        rows = sharding.shuffle_into_shards(df, shards=8, seed=4).collect()
        assert Counter((r.doc_id, r._key2) for r in rows) == Counter((None if i % 9 == 0 else i % 50, i) for i in range(n))
        sizes = Counter(r.shard for r in rows)
        assert n < 8 or max(sizes.values()) - min(sizes.values()) <= 1
        for s in sizes:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    own = spark.createDataFrame([(k, "x", k, k, 5, 6, 7, 8) for k in range(90)], "id int, _key string, _row int, _rank int, _part int, _cuts int, _again int, __row int")
    assert sorted(map(tuple, sharding.shuffle_into_shards(own, shards=3).drop("shard", "slot").collect())) == sorted(map(tuple, own.collect()))
    g = np.random.Generator(np.random.PCG64(0))
    big = [sharding._hypergeometric(g, 3 * 10**9, 5 * 10**9, 1000) for _ in range(400)]
    assert abs(np.mean(big) - 375) < 4 and 12 < np.std(big) < 19
    m = sharding.communication_matrix([10, 0, 25, 4], 8, 1)
    assert m.sum(1).tolist() == [10, 0, 25, 4] and m.sum(0).max() - m.sum(0).min() <= 1


def test_sharding_is_uniform():
    """Rows' shards and slots over many seeds, by the draws that the operator makes, against chi-square bounds (p about 1e-6)."""
    sizes, shards, seeds = [5, 2, 9], 4, 4000
    where = np.zeros((16, shards))
    for seed in range(seeds):
        m, g, row = sharding.communication_matrix(sizes, shards, seed), np.random.default_rng(seed), 0
        for p, n in enumerate(sizes):
            for r, k in zip(row + g.permutation(n), np.repeat(range(shards), m[p]), strict=True):
                where[r, k] += 1
            row += n
    assert ((where - seeds / shards) ** 2 / (seeds / shards)).sum() < 110  # 16 rows x 3 degrees of freedom


def test_shuffle_is_uniform(spark):
    """One row's place over the slots of many shuffles: all rows of all seeds, in one table each."""
    n, shards, seeds, at = 40, 4, 30, Counter()
    for seed in range(seeds):
        for r in sharding.shuffle_into_shards(spark.range(n).repartition(5), shards=shards, seed=seed).collect():
            at["shard", r.id % 5, r.shard] += 1
            at["half", r.id % 5, r.slot < 5] += 1
    for kind, cells in (("shard", 4), ("half", 2)):
        want = seeds * n / 5 / cells
        assert sum((v - want) ** 2 / want for k, v in at.items() if k[0] == kind) < 55  # 15 degrees at most


def test_topk(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(400, 24)).astype(np.float32)
    v[50:90] = v[50]
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(700, None, 1), (800, [float("nan")] * 24, 1), (900, [None] + [0.0] * 23, 1), (None, rows[0][1], 1), (1000, [1.0, 2.0], 1)]
    schema = "vec_id long, embedding array<float>, score int"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=10, query_block=2).collect())
    q = np.floor(1024 * v.astype(float)).astype(np.int64)
    want = []
    for i in range(0, 400, 100):
        s = q @ q[i]
        best = sorted((-int(s[j]), j) for j in range(400) if j != i)[:10]
        want += [(i, k + 1, j, -x) for k, (x, j) in enumerate(best)]
    assert got == sorted(want)
    huge = spark.createDataFrame([(0, [3e18, 1.0]), (1, [2.0, 1.0]), (2, [5e15, 7.0])], "vec_id long, embedding array<double>")
    top = topk.top_k(huge, huge.where("vec_id = 0"), k=5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in top] == [(1, 2**63 - 1), (2, 2**63 - 1)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = toxicity.score(docs, model).join(toxicity.labelled(labels, held_out=True), "doc_id").collect()
    assert all(r.held_out for r in got) and all(r.predicted == (r.score >= 0.7) for r in got)
    caught = lambda rows: sum(r.predicted for r in rows) / len(rows)
    for name in ("en", "de", "fr", "es"):
        toxic = [r for r in got if r.y and lang[r.doc_id] == name]
        assert len(toxic) >= 10 and caught(toxic) >= 0.85, name
    assert caught([r for r in got if r.y]) >= 0.9 and caught([r for r in got if not r.y]) <= 0.01
    odd = toxicity.score(docs_of(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score < 0.7 for r in odd)
    empty = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs_of(spark, ["fine", None]), empty).where("predicted = 0").count() == 2
    assert toxicity.keep_clean(docs, model).columns == docs.columns


def test_lexicon_against_plain_selection(spark):
    """The same terms by plain Python: counts, Chernoff's bound, the bar over all terms, the ratio."""
    rng, common = random.Random(12), [f"word{i}" for i in range(300)]
    rows = []
    for k in range(400):
        y = int(k % 8 == 0)
        words = rng.choices(common, k=30) + ([rng.choice(["vile", "foul", "rotten"])] if y and rng.random() < 0.8 else []) + (["odd"] if k % 50 == 0 else [])
        rows.append((y, " ".join(words)))
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "y int, text string"))
    seen = [Counter(w for y, t in rows if y == side for w in set(t.split())) for side in (0, 1)]
    toxic = sum(y for y, _ in rows)
    clean, share, surprise = len(rows) - toxic, (toxic + 0.5) / (len(rows) + 1), {}
    for w in {*seen[0], *seen[1]}:
        c, t = seen[0][w], seen[1][w]
        surprise[w] = 0.0 if t <= share * (t + c) else t * np.log(t / (t + c) / share) + (c * np.log(c / (t + c) / (1 - share)) if c else 0.0)
    bar = min((k / 10 for k in range(2000) if len(surprise) * np.exp(-k / 10) <= 0.1 * sum(v >= k / 10 for v in surprise.values())), default=np.inf)
    want = {w for w, v in surprise.items() if v >= bar and (seen[1][w] + 0.5) / (toxic + 1) >= 20 * (seen[0][w] + 0.5) / (clean + 1)}
    assert want == {"vile", "foul", "rotten"} == set(lexicon.words) and not lexicon.stems


def test_automaton_and_context():
    lex = toxicity.Lexicon(frozenset({"worthless", "moron", "scum", "pathetic"}), frozenset({"lostra", "vequ"}))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(2)
    for _ in range(1500):
        w = list(rng.choice(["worthless", "pathetic", "lostraum"]))
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, rng.choice("abmo")), lambda: w.__setitem__(k, rng.choice("xyst")), lambda: w.pop(k) if len(w) > 1 else None])()
        w = "".join(w)
        near = any(distance(w, t) <= toxicity.edits(len(t)) for t in lex.words if toxicity.edits(len(t))) or len(w) > 6 and any(distance(w[:n], "lostra") <= 1 for n in range(1, len(w) + 1))
        assert lex.near(w) == near, w
    assert [lex.kind(w) for w in ("moron", "vequxyz", "m0ron", "mooooron", "wothles", "scvm", "table")] == [1, 2, 3, 3, 3, 0, 0]
    calm = toxicity.features('he said "moron" and left', lex, {})
    hot = toxicity.features("you moron are scum", lex, {})
    assert calm[3] > 0 and calm[0] == 0 and hot[0] == 1 and hot[4] > 0
    bent = toxicity.features("what a mooron this is", lex, {})
    assert bent[2] == 1 and toxicity.Lexicon(lex.words, lex.stems, frozenset({"mooron"})).kind("mooron") == 0
    rows = [(1, toxicity.features("you are scum", lex, {}))] * 40 + [(0, None)] * 400
    w = toxicity.fit(rows)
    logit = lambda f: w[0] + float(np.dot(w[1:], f))
    assert logit(hot) > 1 and logit(bent) > 1 and logit(calm) < -1


def plain_measures(text):
    spaces = " \t\n\x0b\x0c\r"
    words = "".join("\n" if c in spaces else c for c in text or "").split("\n")
    words = [w for w in words if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + o for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(spaces)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_measures_and_guarantee(spark):
    texts = texts_of(spark) + ODD + ["a b c a b c a b c d", "x\nx\n \nx"]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(0, 200, 2)] + [(0, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        want = plain_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns and sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.judge(docs.limit(0), labels).count() == 0 and quality.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    for n, k, a in ((100, 3, 0.05), (5000, 40, 0.0125), (50, 0, 0.05)):
        p = spark.sql(f"SELECT {quality._tail('n', 'k', a)} AS p FROM (SELECT {n}L AS n, {k}L AS k)").first().p
        assert p == pytest.approx(sum(comb(n, i) * a**i * (1 - a) ** (n - i) for i in range(k + 1)), rel=1e-9)


def test_cutoffs_are_certified(spark):
    n = 3000
    m = spark.range(n).selectExpr("id AS doc_id", "if(id % 3 = 0, 'de', 'en') AS stratum", "300L AS word_chars", "if(id % 100 = 1, 40L, 0L) AS n_symbols", "0L AS n_bangs", "0L AS n_capitals", "9L AS n_lines", "0L AS n_dup_lines", "100L AS n_words", "0L AS n_repeat_words")
    out = {(r.stratum, r.rule): r for r in quality.cutoffs(m, m.selectExpr("doc_id", "1 AS quality")).collect()}
    level, share = 0.05 / 8, 0.05 / 4
    assert out["en", "capitals"].cutoff == 0.4 and out["en", "noise"].cutoff == 0.4 and out["en", "noise"].k == 0
    assert all(sum(comb(r.n, i) * share**i * (1 - share) ** (r.n - i) for i in range(r.k + 1)) <= level for r in out.values())


def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    fits = [(len(r), r, a) for r, a in rules for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "https://com/", "http://x.com", "HTTP://EXAMPLE.com/en/x", "http://www.example.com/en/?q", "http://a.net/es/", "http://a.net/es", "http://net/fr/b#c", "http://xexample.com/en/", "http://a.net/ES/", "x://h?a/b", "http://é.net/es/é", "http://casino.org/", "ftp://spam-farm.org/a/", "http://x.org/poker", "http://x.net/" + "a/" * 5000]
    pages = spark.createDataFrame([(k, u, "h", "v") for k, u in enumerate(urls)] + [(None, "http://x.com/", "h", "v")], "page_id long, url string, host string, verdict string")
    extra = tuple(urlfilter.word_rule(f"unseen{k}") for k in range(urlfilter.INLINE_RULES))
    for rules in (urlfilter.WORD_RULES, urlfilter.WORD_RULES + extra):
        got = {r.page_id: r for r in urlfilter.judge(pages, rules=urlfilter.HOST_RULES + rules).collect()}
        assert len(got) == len(urls) + 1
        for k, u in enumerate(urls):
            host, path, rule, action = plain_rule(u)
            r = got[k]
            assert (r.host, r.path, r.rule) == (host, path, rule), u
            word = any(w in (host + path).lower() for w in ("casino", "poker", "spam-farm"))
            assert r.verdict == (action or ("block" if word else "allow")), u
    assert urlfilter.judge(pages.limit(0)).count() == 0
    many = spark.range(100_000).selectExpr("concat('word:w', id) AS name", "'block' AS action", "concat('(?:^|[^a-z0-9])w', id, '(?:[^a-z0-9]|$)') AS pattern", "array(concat('w', id)) AS tokens", "0 AS weight", "false AS host")
    some = spark.createDataFrame([(1, "http://a.org/w99999/x"), (2, "http://w7.org/"), (2, "http://w7.org/"), (3, "http://b.org/w100000"), (4, None)], "page_id long, url string")
    assert sorted((r.page_id, r.verdict, r.pattern_rule) for r in urlfilter.judge(some, rules=many).collect()) == [(1, "block", "word:w99999"), (2, "block", "word:w7"), (2, "block", "word:w7"), (3, "allow", None), (4, "allow", None)]
    bare = many.where("name IN ('word:w99999', 'word:w7')").union(many.limit(2 * urlfilter.INLINE_RULES)).selectExpr("name", "action", "pattern", "cast(array() AS array<string>) AS tokens", "weight", "host").distinct()
    assert sorted((r.page_id, r.verdict, r.pattern_rule) for r in urlfilter.judge(some, rules=bare).collect()) == [(1, "block", "word:w99999"), (2, "block", "word:w7"), (2, "block", "word:w7"), (3, "allow", None), (4, "allow", None)]


def test_warc(spark):
    rng = random.Random(9)
    rows = []
    for k in range(600):
        kind = rng.choice(["response", "revisit", "request", None])
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        url = rng.choice(["http://WWW.x.org/a/?utm_source=q", "https://x.org/a", "http://x.org:80/a/#t", "http://y.org/?b=2&a=1", "y.org?a=1&b=2", None])
        headers = {h: v for h, v in (("etag", tag), ("content-length", str(k)), ("x-new", str(k))) if v}
        rows.append((k, kind, url, rng.choice([None, k // 3]), rng.choice([200, 200, 404]), headers, rng.choice([None, "d1"]), "extra"))
    df = spark.createDataFrame(rows, "record_id long, warc_type string, url string, captured long, status int, headers map<string,string>, digest string, resolution string")
    canon = {"y": "y.org?a=1&b=2", "x": "x.org/a"}
    got = {r.record_id: r for r in warc.resolve_revisits(df, rows_per_range=40).collect()}
    assert len(got) == 600
    full = [r for r in rows if r[1] == "response" and r[4] == 200 and r[2] and r[3] is not None]
    clean = lambda t: t and t.replace("W/", "").replace('"', "")
    key = lambda u: u and canon["y" if "y.org" in u else "x"]
    for r in rows:
        g = got[r[0]]
        assert g.canonical_url == key(r[2])
        if r in full:
            assert g.resolution == "full" and g.resolved_id == r[0]
        elif r[1] != "revisit":
            assert g.resolution == "other"
        else:
            before = [f for f in full if key(f[2]) == key(r[2]) and r[3] is not None and (f[3], f[0]) < (r[3], r[0])]
            hit = max(before, key=lambda f: (f[3], f[0]), default=None)
            if hit is None:
                assert g.resolution == "unresolved" and g.resolved_id is None
                continue
            a, b = clean(r[5].get("etag")), clean(hit[5].get("etag"))
            clash = (a != b if a and b else False) or (r[6] is not None and hit[6] is not None and r[6] != hit[6])
            assert g.resolution == ("mismatch" if clash else "resolved"), r
            if not clash:
                assert g.resolved_id == hit[0] and g.merged_headers["content-length"] == str(hit[0]) and g.merged_headers["x-new"] == str(r[0])
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    first = [(None, "response", "http://x.org/", 0, 200, {"etag": '"a"'}, "d1", "")] + [(k, "revisit", "http://x.org/", k, 304, {"etag": '"a"'}, None, "") for k in range(1, 59)]
    found = warc.resolve_revisits(spark.createDataFrame(first, df.schema), rows_per_range=10).collect()
    assert Counter(r.resolution for r in found) == {"full": 1, "resolved": 58} and all(r.resolved_digest == "d1" for r in found)


def test_licenses(spark):
    texts = [*ODD, "words here\nLicensed under CC BY-NC 4.0.\nmore", "This work is  licensed under the GNU General Public License,\tversion 3.", "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "We met the license officer and had tea.", "This work is licensed under the GNU Lesser General Public License, version 3.", "Licenced under CC BY 4.0", "This work was licensed under the GNU General Public License, version 9."]
    got = defaultdict(list)
    for r in licenses.find_licenses(docs_of(spark, texts).withColumnRenamed("key", "license")).collect():
        got[r.doc_id].append(r.license)
    n = len(ODD)
    assert {k: sorted(v) for k, v in got.items()} == {n: ["CC-BY-NC-4.0"], n + 1: ["GPL-3.0"], n + 2: ["Apache-2.0", "MIT"], n + 4: ["LGPL-3.0"], n + 5: ["CC-BY-4.0"]}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = Counter(r.license for r in licenses.find_licenses(docs).collect())
    lines = {"CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    assert {k: v for k, v in found.items()} == {k: n for k, t in lines.items() if (n := docs.where(docs.text.contains(t)).count())}


def test_licenses_wrapped_and_altered(spark):
    import textwrap

    full = lambda name: licenses.TEMPLATES[name][-1]
    prose = "The harbour lies east of the town. " * 60
    texts = []
    for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0", "Unlicense", "ISC"):
        wrapped = textwrap.fill(full(name), 72)
        texts += [(name, wrapped), (name, textwrap.indent(wrapped, " * ")), (name, prose + "\n" + wrapped + "\n" + prose * 9), (name, wrapped.replace("software", "programs"))]
    texts += [("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"), ("CC-BY-NC-ND-4.0", "under a Creative Commons\nAttribution-NonCommercial-NoDerivatives 4.0 International License"), ("BSD", licenses._BSD), (None, "Permission is hereby granted, free of charge, to any person to walk on the grass of this garden until the evening bell"), (None, prose + "All rights reserved."), (None, "free software is licensed " * 3000)]
    mit = full("MIT").split(" The above ")
    texts.append(("MIT", f"Copyright 2020 Kim\n\n{textwrap.fill(mit[0], 70)}\n\n{textwrap.fill('The above ' + mit[1], 70)}"))
    got = defaultdict(set)
    for r in licenses.find_licenses(docs_of(spark, [t for _, t in texts])).collect():
        got[r.doc_id].add(r.license)
    assert [got[k] for k in range(len(texts))] == [{n} if n else set() for n, _ in texts]
    at = {r.doc_id: r.start for r in licenses.find_licenses(docs_of(spark, ["x y.\n\nzz\n\nReleased under the MIT License."])).collect()}
    assert at == {0: 10}


def test_license_ranking_by_plain_compression():
    """The ranking is that of sizes with and without each raw dictionary, and wording shares are those of a plain LCS."""
    import zstandard

    block = "we ship this. " + licenses.TEMPLATES["GPL-2.0"][2] + " more text"
    flat = " ".join(block.lower().split()).encode()
    bare = len(zstandard.ZstdCompressor(level=licenses.LEVEL, write_content_size=False).compress(flat))
    saved = {}
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            d = zstandard.ZstdCompressionDict((" ".join(t.lower().split()) + "\n").encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            saved[name] = max(saved.get(name, 0), bare - len(zstandard.ZstdCompressor(level=licenses.LEVEL, dict_data=d, write_dict_id=False, write_content_size=False).compress(flat)))
    (found,) = licenses.classify(block)
    assert found[:3] == ("GPL-2.0", saved["GPL-2.0"], bare) and found[3] == 1.0 and max(saved, key=saved.get) in ("GPL-2.0", "GPL-3.0")

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old = row[:]
            for j, y in enumerate(b, 1):
                row[j] = old[j - 1] + 1 if x == y else max(row[j - 1], old[j])
        return row[-1]

    rng = random.Random(6)
    template = licenses.WORDS.findall(licenses.TEMPLATES["Apache-2.0"][1].lower())
    for _ in range(50):
        words = ["pre"] * rng.randrange(30) + [w if rng.random() > 0.1 else "zz" for w in template] + ["post"] * rng.randrange(30)
        share, missing, *_ = licenses.wording(template, words)
        assert share == pytest.approx(lcs(template, words) / len(template), abs=0.06) and len(missing) == round((1 - share) * len(template))


def test_materialize_keeps_schema(spark):
    df = spark.createDataFrame([], "a long, b array<string>")
    assert materialize(df, "x").schema.simpleString() == df.schema.simpleString()


def test_written_tables_go(spark):
    from folioforge.llm.common import shared_dir, spare, written_tables
    from pathlib import Path

    with written_tables(spark):
        materialize(spark.range(3), "x")
        held = set(Path(shared_dir(spark), "folioforge").iterdir())
    assert not any(p.exists() and not any(p.iterdir()) for p in held) and len(set(Path(shared_dir(spark), "folioforge").iterdir())) == len(held) - 1
    assert spare(spark.createDataFrame([(1, 2)], "_A int, b int"), "a", "c") == ["__a", "__c"]


def test_similar_documents_of_the_table(spark):
    """Recall and exactness on whole documents: components against those of all pairs by exact Jaccard similarity."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: frozenset(simhash.shingle_set(r.text, 5).tolist()) for r in docs.collect()}
    holders, shared = defaultdict(list), Counter()
    for k, s in sets.items():
        for x in s:
            shared.update((j, k) for j in holders[x])
            holders[x].append(k)
    close = [(a, b) for (a, b), n in shared.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    other = [(a, b) for a, b in close if sets[a] != sets[b]]
    assert len(other) >= 10 and sum(found[a] == found[b] for a, b in other) >= 0.9 * len(other)
    parent = {k: k for k in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in close:
        parent[top(a)] = top(b)
    assert all(top(k) == top(c) for k, c in found.items() if sets[k])  # nothing is joined beyond these
