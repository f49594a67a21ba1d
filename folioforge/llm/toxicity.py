"""Toxicity scores: a learned lexicon, misspellings by automaton, and the context in which a term stands.

The lexicon (whole words, and stems that begin many words) is learned from labelled documents: terms far more common in toxic
than in clean ones. It is held in a trie. A word that is no term is run as a Levenshtein automaton through that
trie, so that misspelled terms are found too. Each occurrence is scored with its context window: quotation marks and
reporting words around it speak for a quotation, second-person words for abuse. A logistic model over the counts
gives the score; its weights are fitted to the labels, starting from a prior that keeps untested evidence sensible.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import map_arrow
from .common import materialize, scratch, table, text_or_empty

#: Labelled documents to fit on, of each class at most about this many (chosen by a hash of the id).
MAX_LABELLED = 10_000
#: How much likelier a term has to be in toxic texts, and the share of terms that may be in the lexicon by chance.
MIN_RATIO, BY_CHANCE = 20.0, 0.1
STEMS = range(4, 9)
#: Toxic texts that a stem needs, more than a word, since there are so many beginnings; or else its uses in each.
MIN_STEM_DOCS, MIN_STEM_USES = 8, 2.5
WORD = re.compile(r"[^\W_]+(?:[*@$][^\W_]+)*")
WINDOW = 6
_RUNS = re.compile(r"(.)\1+")
THRESHOLD = 0.7
MEMO_WORDS = 400_000
LEET = str.maketrans("013457@$*", "oleast" + "as" + "*")
#: What stands inside a matched pair of quotation marks on one line; an apostrophe between letters ends nothing.
QUOTED = re.compile(r'(?<!\w)"[^"\n]*"(?!\w)|“[^“”\n]*”|„[^„“”\n]*[“”]|«[^«»\n]*»|»[^«»\n]*«|(?<!\w)‘(?:[^‘’\n]|(?<=\w)’(?=\w))*’(?!\w)')
#: Words that report what somebody said, and words that address somebody; the same in every corpus.
REPORTING = frozenset("said says quote quoted quotes word words term terms called wrote writes meaning means dit mot mots wort worte sagte hieß dijo palabra palabras".split())
ADDRESS = frozenset("you your youre u ur tu vous ton votre du dich dein ihr usted vosotros".split())
FEATURES = ("hit", "count", "near_only", "quoted", "addressed", "density", "reported")
#: Weights before any label is seen (bias first), and how firmly they are held. Misspellings count nearly as much as
#: the terms themselves, quotations hardly, even where no labelled document has any; reporting words only weaken a hit.
PRIOR = np.array([-4.0, 5.0, 1.0, -1.0, 0.3, 0.7, 0.5, -1.0])
PRIOR_STRENGTH = np.array([0.05, 0.05, 0.5, 2.0, 2.0, 2.0, 2.0, 2.0])


# ---- lexicon trie and automaton


class Trie:
    __slots__ = ("kids", "term", "stem")

    def __init__(self) -> None:
        self.kids: dict[str, Trie] = {}
        self.term = self.stem = False

    def add(self, word: str, stem: bool) -> None:
        node = self
        for c in word:
            node = node.kids.setdefault(c, Trie())
        node.stem |= stem
        node.term |= not stem


class Levenshtein:
    """The automaton of all strings within `k` edits of `word`; states are rows of the edit table, sparse in position."""

    def __init__(self, word: str, k: int):
        self.word, self.k = word, k

    def start(self) -> tuple[tuple[int, int], ...]:
        return tuple((i, i) for i in range(min(self.k, len(self.word)) + 1))

    def step(self, state: tuple[tuple[int, int], ...], c: str) -> tuple[tuple[int, int], ...]:
        out: list[tuple[int, int]] = []
        word, n, k = self.word, len(self.word), self.k
        before = dict(state)
        if state and state[0][0] == 0 and state[0][1] < k:
            out.append((0, state[0][1] + 1))
        for i, e in state:
            if i == n:
                break
            v = e if word[i] == c else e + 1
            if out and out[-1][0] == i:
                v = min(v, out[-1][1] + 1)
            if (up := before.get(i + 1)) is not None:
                v = min(v, up + 1)
            if v <= k:
                out.append((i + 1, v))
        return tuple(out)

    def accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        return bool(state) and state[-1][0] == len(self.word)

    def prefix_accepts(self, state: tuple[tuple[int, int], ...]) -> bool:
        """Some prefix of the word is within k edits, and what follows goes on for a letter at least."""
        return any(0 < i < len(self.word) for i, _ in state)


def edits(term_length: int) -> int:
    """Edits allowed for a term: short ones would turn into other words."""
    return 0 if term_length < 5 else 1 if term_length < 9 else 2


@dataclass
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]
    #: Words that the automaton would take for misspelled terms, but which clean texts use.
    safe: frozenset[str] = frozenset()
    trie: Trie = field(init=False, repr=False, compare=False)
    pieces: dict[str, list[tuple[int, int, int, int]]] = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        self.trie, self.pieces = Trie(), {}
        self.squeezed = frozenset(_RUNS.sub(r"\1", w) for w in self.words)
        self.sizes = tuple(sorted({len(s) for s in self.stems}))
        for w in sorted({*self.words, *self.stems}):
            stem = w in self.stems
            if (k := edits(len(w))) and not (stem and len(w) < 6):
                self.trie.add(w, stem)
                cut = [len(w) * i // (k + 1) for i in range(k + 2)]
                for a, b in zip(cut, cut[1:], strict=False):
                    self.pieces.setdefault(w[a:b], []).append((a, k, len(w) - k, len(w) + k if not stem else 1 << 30))
        self.piece_sizes = tuple(sorted({len(p) for p in self.pieces}))

    def may_be_near(self, word: str) -> bool:
        """k edits leave one of k + 1 pieces of a term whole and at most k places off: without any, no edit finds it."""
        n = len(word)
        for size in self.piece_sizes:
            for i in range(n - size + 1):
                for at, k, least, most in self.pieces.get(word[i : i + size], ()):
                    if -k <= i - at <= k and least <= n <= most:
                        return True
        return False

    def kind(self, word: str) -> int:
        """0 no term, 1 a term, 2 begins with a stem, 3 within the allowed edits of a term or stem."""
        if word in self.words:
            return 1
        if any(word[:n] in self.stems for n in self.sizes):
            return 2
        if len(word) < 4 or word in self.safe:
            return 0
        plain = word.translate(LEET) if not word.isalpha() else word
        once = _RUNS.sub(r"\1", plain)
        if plain in self.words or once in self.squeezed and once != word or plain != word and any(plain[:n] in self.stems for n in self.sizes):
            return 3
        return 3 if self.may_be_near(plain) and self.near(plain) else 0

    def near(self, word: str) -> bool:
        """Whether the automaton of `word` and the trie have a string in common, at the edits that string allows."""
        machines = [Levenshtein(word, k) for k in (1, 2)]
        todo = [(self.trie, 0, *(m.start() for m in machines))]
        while todo:
            node, depth, one, two = todo.pop()
            if node.term or node.stem:
                m, state = (machines[0], one) if edits(depth) == 1 else (machines[1], two)
                if node.term and m.accepts(state) or node.stem and len(word) > depth and (m.prefix_accepts(state) or m.accepts(state)):
                    return True
            for c, kid in node.kids.items():
                a, b = machines[0].step(one, c), machines[1].step(two, c)
                if b:
                    todo.append((kid, depth + 1, a, b))
        return False


# ---- learning


def labelled(labels: DataFrame, *, label: str = "toxic", held_out: bool = False) -> DataFrame:
    """(doc_id, y) of the labelled rows to learn from, or of the held-out ones: crc32(doc_id as text) mod 3 is 1.

    A document labelled both ways counts as toxic. Null ids and labels count for nothing.
    """
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    return rows.where(part == 1 if held_out else part != 1).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))


def sample(docs: DataFrame, chosen: DataFrame, *, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, text) of about `most` labelled documents of each class; of near copies (one MinHash of word triples) one stays."""
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    keep = F.lit(False)
    for y, n in sizes.items():
        keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most / n))))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").join(F.broadcast(chosen.where(keep)), "doc_id")  # 2 * most rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh3_64_intdigest
        for b in batches:
            keys = []
            for t in b.column(2).to_pylist():
                w = t.split()
                keys.append(min((h(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], ["doc_id", "y", "text", "key"])

    keyed = map_arrow(rows.select("doc_id", "y", "text"), run, "doc_id long, y int, text string, key long")
    return keyed.groupBy("key", "y").agg(F.min_by("text", "doc_id").alias("text")).select("y", "text")


def term_counts(rows: DataFrame, stems: range = STEMS) -> DataFrame:
    """(term, toxic, clean, uses): in how many texts of each class each word, and each beginning of words (ends in *),
    occurs, and how often in toxic texts."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64()), ("uses", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, uses = (Counter(), Counter()), Counter()

        def out() -> pa.RecordBatch:
            terms = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((terms, [seen[1][t] for t in terms], [seen[0][t] for t in terms], [uses[t] for t in terms]), schema, strict=True)], schema=schema)
            for c in (*seen, uses):
                c.clear()
            return batch

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = Counter(WORD.findall(t.lower()))
                seen[y].update(words.keys())
                seen[y].update({w[:n] + "*" for w in words for n in stems if len(w) > n})
                if y:
                    uses.update(words)
                    for w, k in words.items():
                        for n in stems:
                            if len(w) > n:
                                uses[w[:n] + "*"] += k
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield out()
        yield out()

    counted = map_arrow(rows.select("y", "text"), run, "term string, toxic long, clean long, uses long")
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "uses")))


def _bar(surprises: DataFrame, by_chance: float) -> float:
    """The surprise from which on at most a share `by_chance` of terms is there by chance (Benjamini and Hochberg), from a
    histogram of tenths; infinite if there is none."""
    bins = sorted((r["bin"], r["n"]) for r in surprises.groupBy(F.floor(F.col("surprise") * 10).alias("bin")).agg(F.count("*").alias("n")).collect())
    total, above, bar = sum(n for _, n in bins), 0, math.inf
    for at, n in reversed(bins):
        above += n
        if total * math.exp(-at / 10) <= by_chance * above:
            bar = at / 10
    return bar


def learn_lexicon(rows: DataFrame, *, min_ratio: float = MIN_RATIO, by_chance: float = BY_CHANCE) -> Lexicon:
    """Terms `min_ratio` times likelier in toxic texts than in clean ones, at most a share `by_chance` of them by chance.

    A term's surprise is Chernoff's bound on the binomial probability that so many of its texts are toxic ones, were toxic
    and clean texts alike. The bar follows from all terms' surprises, so a term needs few texts where toxic ones are
    rare, and no larger share of a larger sample. Beginnings count as stems if four words that only toxic texts use
    share them. Terms number no more than the bounded sample can bear out.
    """
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return Lexicon(frozenset(), frozenset())
    share = (toxic + 0.5) / (toxic + clean + 1)
    of, stem = F.col("toxic") + F.col("clean"), F.endswith("term", F.lit("*"))
    surprise = F.col("toxic") * F.log(F.col("toxic") / of / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / of / (1 - share))).otherwise(0.0)
    surprise = F.when(F.col("toxic") > share * of, surprise).otherwise(0.0)
    counted = materialize(term_counts(rows).withColumn("surprise", surprise).withColumn("stem", stem), "terms")
    bar = F.when(F.col("stem"), _bar(counted.where("stem"), by_chance)).otherwise(_bar(counted.where("NOT stem"), by_chance))
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    wanted = F.when(F.col("stem"), 10 * min_ratio).otherwise(min_ratio)  # beginnings are many
    found = counted.where((F.col("surprise") >= bar) & (ratio >= wanted)).collect()
    words = {r["term"]: r["toxic"] for r in found if not r["term"].endswith("*")}
    begun = {r["term"]: r["toxic"] for r in found if r["term"].endswith("*") and (r["toxic"] >= MIN_STEM_DOCS or r["uses"] >= MIN_STEM_USES * r["toxic"])}
    longer = counted.where("clean = 0 AND NOT endswith(term, '*')").select(F.explode(F.transform(F.array(*map(F.lit, STEMS)), lambda n: F.concat(F.left("term", n), F.lit("*")))).alias("term"))
    spread = {r["term"] for r in longer.where(F.col("term").isin(list(begun))).groupBy("term").count().where("count >= 4").collect()} if begun else set()
    stems: list[str] = []
    for s in sorted((t[:-1] for t in begun if t in spread), key=lambda t: (len(t), t)):
        if not s.startswith(tuple(stems)):
            stems.append(s)
    whole = (w for w in words if not w.startswith(tuple(stems)) and len(w) > 2)
    return Lexicon(frozenset(whole), frozenset(stems))


def features(text: str, lexicon: Lexicon, memo: dict[str, int]) -> tuple[float, ...] | None:
    """FEATURES of one text; None if no term occurs. Occurrences in quotation marks are counted apart from hits."""
    lower = text.lower()
    words = WORD.findall(lower)
    distinct = set(words)
    new = distinct.difference(memo)
    if new:
        if len(memo) + len(new) > MEMO_WORDS:
            memo.clear()
            new = distinct
        for w in new:
            memo[w] = lexicon.kind(w)
    if not any(map(memo.__getitem__, distinct)):
        return None
    sure = near_ = quoted = addressed = reported = 0
    spans = [m.span() for m in QUOTED.finditer(lower)]
    for at, m in enumerate(WORD.finditer(lower)):
        kind = memo[m[0]]
        if kind:
            near = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
            addressed += not ADDRESS.isdisjoint(near)
            if any(a < m.start() and m.end() < b for a, b in spans):
                quoted += 1
                continue
            reported += not REPORTING.isdisjoint(near)
            sure += kind < 3
            near_ += kind == 3
    hits = sure + near_
    return float(hits > 0), math.log1p(hits), float(hits > 0 and not sure), math.log1p(quoted), math.log1p(addressed), math.log1p(100 * hits / len(words)), math.log1p(reported)


def fit(rows: list[tuple[int, tuple[float, ...] | None]]) -> np.ndarray:
    """Weights (bias first) that maximize the labels' likelihood times the prior, by Newton's method."""
    w = PRIOR.copy()
    if not rows:
        return w
    x = np.array([(1.0, *(f or (0.0,) * len(FEATURES))) for _, f in rows])
    y = np.array([t for t, _ in rows], float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + PRIOR_STRENGTH * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(PRIOR_STRENGTH), grad)
        size = np.abs(step).max()
        w = w - step * min(1.0, 2.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w


def _table(rows: DataFrame, lexicon: Lexicon) -> list[tuple[int, tuple[float, ...] | None]]:
    """Label and features of each row of the bounded sample; equal rows are counted where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            f = [features(t, lexicon, memo) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.float64()))], ["y", "f"])

    return [(r["y"], tuple(r["f"]) if r["f"] is not None else None) for r in map_arrow(rows.select("y", "text"), run, "y int, f array<double>").collect()]


def safe_words(rows: DataFrame, lexicon: Lexicon) -> frozenset[str]:
    """Words of clean texts of the bounded sample that the automaton takes for misspelled terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = set().union(*(WORD.findall(t.lower()) for t in b.column(1).to_pylist()))
            near = [w for w in words if lexicon.kind(w) == 3]
            yield pa.RecordBatch.from_arrays([pa.array(near, pa.string())], ["word"])

    return frozenset(r["word"] for r in map_arrow(rows.where("y = 0").select("y", "text"), run, "word string").distinct().collect())


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, *, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = materialize(sample(docs, labelled(labels), most=most, id_col=id_col, text_col=text_col), "labelled")
    lexicon = learn_lexicon(rows)
    lexicon = Lexicon(lexicon.words, lexicon.stems, safe_words(rows, lexicon))
    return Model(lexicon, fit(_table(rows, lexicon)))


def _scorer(sent):
    """A function from a list of texts to their scores."""
    scratch("toxicity")
    *terms, w = sent.value
    lexicon, memo = Lexicon(*terms), {}

    def run(texts: list[str | None]) -> np.ndarray:
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            f = features(t or "", lexicon, memo)
            z = w[0] + (float(np.dot(w[1:], f)) if f else 0.0)
            out[k] = 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))
        return out

    return run


def _send(docs: DataFrame, model: Model):
    """The model that goes to the executors: terms and exceptions of the bounded sample."""
    return docs.sparkSession.sparkContext.broadcast((model.lexicon.words, model.lexicon.stems, model.lexicon.safe, model.weights))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from its text alone.

    Null and empty texts have no terms and get the score of such texts. Null ids are not held out; ids may repeat.
    """
    sent = _send(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(sent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    scored = map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("doc_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, whole, with a score under `threshold`; nothing is shuffled."""
    sent, fields, at = _send(docs, model), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scorer(sent)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).to_pylist()) < threshold))

    return map_arrow(docs, run, fields)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
