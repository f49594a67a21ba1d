"""The pipeline's stages against plain versions of themselves, and its run."""

import random
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from folioforge.llm import quality, registry, simhash, toxicity

from test_llm_operators import jaccard

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    (_, tox), (_, qual), (_, near), (_, pack) = corpus_pipeline.STAGES

    clean = tox(spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, labels)
    memo = {}
    want = {k for k, t in texts.items() if (f := toxicity.features(t or "", model.lexicon, memo)) is None or model.weights[0] + sum(a * b for a, b in zip(model.weights[1:], f, strict=True)) < 0.8472978}
    ids = {r.doc_id for r in clean.collect()}
    assert ids == want
    # other languages have five toxic documents at most in this table, too few to learn their terms from
    toxic = {r.doc_id for r in labels.where("toxic = 1").join(docs.where("lang = 'en'"), "doc_id").collect()}
    assert len(toxic) > 20 and len(toxic & ids) <= 0.1 * len(toxic)
    fine = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(fine & ids) >= 0.99 * len(fine)

    good = qual(spark, clean, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert kept == {r.doc_id for r in quality.judge(clean, labels).where("kept").collect()}

    single = near(spark, good, SF)
    assert single.columns == docs.columns
    left = {r.doc_id for r in single.collect()}
    assert left <= kept
    by_text = defaultdict(list)
    for k in kept:
        by_text[texts[k]].append(k)
    for group in by_text.values():
        assert len(left & set(group)) <= 1
    gone = kept - left
    assert all(any(jaccard(texts[g], texts[k]) >= 0.7 for k in kept if k < g) for g in gone)

    packed = pack(spark, single, SF).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = defaultdict(int)
    for r in packed:
        total[r.doc_id] += r.length
    assert set(total) == left
    assert all(total[k] == len(t.encode(texts[k], add_special_tokens=False).ids) + 1 for k in sorted(left)[:40])


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    assert sorted(registry.QUERIES) == sorted(f"op{n}_{x}" for n, x in enumerate("toxicity simhash warc bpe topk licenses quality packing urlfilter sharding pii fim trie".split(), 1))


def test_similar_pairs_by_their_shingles(spark):
    """Recall on pairs with a Jaccard similarity of 0.80 to 0.85, and no joins at 0.70 to 0.79, for several sizes."""
    rng, texts, pairs = random.Random(5), [], []
    for size in (60, 200, 600):
        for tenth in range(700, 850, 3):
            new = round(size * (1 - tenth / 1000) / (1 + tenth / 1000))  # shingles that only the second text has
            base = [f"{size}x{tenth}x{k}" for k in range(size + 4)]
            # a changed tail changes as many shingles as it has words
            other = base[: len(base) - new] + [f"y{w}" for w in base[len(base) - new :]] if new else base
            s = jaccard(" ".join(base), " ".join(other))
            pairs.append((len(texts), len(texts) + 1, s))
            texts += [" ".join(base), " ".join(other)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(docs, list_rows=4).collect()}
    close = [found[a] == found[b] for a, b, s in pairs if s >= 0.8]
    apart = [found[a] == found[b] for a, b, s in pairs if 0.7 <= s < 0.8]
    assert len(close) > 40 and sum(close) >= 0.98 * len(close)
    assert len(apart) > 60 and not any(apart)


def test_short_terms_are_found_misspelled():
    lex = toxicity.Lexicon(frozenset("trash idiot loser moron clown".split()), frozenset())
    bent = "idlot trsh clwn losr moorn morn moronn oron".split()
    want = [3, 3, 3, 3, 0, 3, 3, 3]  # 'moorn' is two edits off
    assert [lex.kind(w) for w in bent] == want
    assert toxicity.Lexicon(lex.words, lex.stems, frozenset({"lower"})).kind("lower") == 0


def test_quotes_are_pairs_and_reporting_words_only_weigh():
    lex = toxicity.Lexicon(frozenset({"idiot"}), frozenset())
    w = toxicity.PRIOR

    def logit(text):
        return w[0] + sum(a * b for a, b in zip(w[1:], toxicity.features(text, lex, {}), strict=True))

    for abuse in ("You’re an idiot and you don’t belong here", "mark my words, you idiot", 'he wrote 5" and you idiot took 7" of it'):
        assert logit(abuse) > 0.8472978, abuse
    for mention in ('the page has "idiot" in it', "la page «idiot» existe", "das Wort „idiot“ steht da", "the page has ‘an idiot’s guide’ in it"):
        assert logit(mention) < 0, mention
    plain, said = (toxicity.features(t, lex, {}) for t in ("an idiot came", "an idiot said"))
    assert plain[:6] == said[:6] and said[6] > plain[6]
