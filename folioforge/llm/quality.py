"""Quality rules with risk-controlled cutoffs. Native: DataFrame and SQL functions only.

Each rule rejects a document whose value lies above a cutoff. Cutoffs come from labelled good documents (the
holdout) per stratum (language): walking from the most lenient cutoff of a fixed grid to the strictest, a cutoff is
certified while the exact binomial tail P(Bin(n, a) <= k) of its k false rejections among n stays within the level,
and the walk ends at the first that is not (fixed-sequence testing). The level is `delta` shared over all strata and
rules (Bonferroni), and a = alpha / number of rules, so that with probability 1 - delta the rules together reject at
most a share `alpha` of the good documents of every stratum. A stratum with too few labels certifies nothing and
keeps what the base rules keep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, text_or_empty

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
#: Rules: SQL value, and cutoffs from lenient to strict. Fixed before any label is seen, as the guarantee asks.
RULES = {
    "noise": ("(n_symbols + n_bangs) / nullif(n_words, 0)", (2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2)),
    "capitals": ("n_capitals / nullif(word_chars, 0)", (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
    "repeats": ("n_repeat_words / nullif(n_words, 0)", (0.5, 0.45, 0.4, 0.35, 0.3)),
    "lines": ("n_dup_lines / nullif(n_lines, 0)", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4)),
}
ALPHA, DELTA = 0.05, 0.05
BASE = "(n_words < 50 OR 100 * n_repeat_words > 50 * n_words)"


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """(doc_id, stratum, word_chars, n_symbols, n_bangs, n_capitals, n_lines, n_dup_lines, n_words, n_repeat_words).

    Words are runs without ASCII white space. Windows of three words count as equal if their 64-bit hashes are; the
    sort by hash keeps the work of a text of n words at n log n. A word is repeated if a window that holds it occurs
    twice or more in the text. Null text: no words, all zeros. Other columns than id, text and lang are not read; with
    `whole`, column _row holds the row of `docs` itself. Write the result before filtering on it: a filter that is
    pushed down repeats the measures' expressions inside their folds.
    """
    keep = [F.struct(*docs.columns).alias("_row")] if whole else []
    also = ["_row"] if whole else []
    has_lang = "lang" in docs.columns
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.col("lang").cast("string"), F.lit("")) if has_lang else F.lit("")).alias("stratum"), text_or_empty(text_col).alias("_t"), *keep)
    trimmed = F.btrim("_t", F.lit(SPACES))
    rows = rows.select(
        "doc_id",
        "stratum",
        *also,
        (F.length("_t") - _without(F.col("_t"), SPACES)).cast("long").alias("word_chars"),
        _without(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        _without(F.col("_t"), "!").cast("long").alias("n_bangs"),
        _without(F.col("_t"), CAPITALS).cast("long").alias("n_capitals"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_lines"),
        F.when(trimmed != "", F.split(trimmed, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")).alias("_w"),
    )
    rows = rows.select("*", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"))
    hashes = F.expr("CASE WHEN n_words < 3 THEN cast(array() AS array<bigint>) ELSE transform(sequence(0, cast(n_words AS int) - 3), i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) END")
    rows = rows.drop("_lines").withColumn("_h", hashes)
    # most texts repeat no window: a set tells, and only the others are sorted
    pairs = F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h AS h, i AS i))) ELSE cast(array() AS array<struct<h:bigint,i:int>>) END")
    rows = rows.select("doc_id", "stratum", *also, "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_lines", "n_dup_lines", "n_words", pairs.alias("_s"))
    found = F.expr("sort_array(transform(filter(transform(_s, (x, j) -> CASE WHEN x.h <=> get(_s, j - 1).h OR x.h <=> get(_s, j + 1).h THEN x.i END), x -> x IS NOT NULL), x -> x))")
    rows = rows.select("*", found.alias("_p"))
    covered = F.expr("cast(aggregate(_p, struct(0 AS n, 0 AS e), (a, x) -> struct(a.n + x + 3 - greatest(x, a.e) AS n, x + 3 AS e), a -> a.n) AS bigint)")
    return rows.select("doc_id", "stratum", *also, "word_chars", "n_symbols", "n_bangs", "n_capitals", "n_lines", "n_dup_lines", "n_words", covered.alias("n_repeat_words"))


def _tail(n: str, k: str, a: float) -> str:
    """SQL for P(Bin(n, a) <= k), summed term by term in logarithms; 1 beyond the mean, where no test passes."""
    first = f"{n} * ln(1 - {a}D)"
    step = f"x.t + ln(({n} - i + 1) / i) + ln({a}D / (1 - {a}D))"
    return f"CASE WHEN {k} > {n} * {a}D THEN 1D WHEN {k} = 0 THEN exp({first}) ELSE aggregate(sequence(1L, {k}), struct({first} AS t, exp({first}) AS s), (x, i) -> struct({step} AS t, x.s + exp({step}) AS s), x -> x.s) END"


def cutoffs(measured: DataFrame, labels: DataFrame, *, rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff, n, k, p): the strictest certified cutoff of each stratum and rule; rows only where there is one.

    Good documents are those with a label of quality 1 (a document labelled both ways counts as not good) that the
    base rules keep. Null labels and ids count for nothing.
    """
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    held = measured.where(f"NOT {BASE}").join(good, "doc_id", "left_semi")
    tests = [f"struct('{r}' AS rule, {k} AS step, {c}D AS cutoff, ({v}) > {c}D AS hit)" for r, (v, grid) in rules.items() for k, c in enumerate(grid)]
    counts = held.select("stratum", F.explode(F.expr(f"array({', '.join(tests)})")).alias("x")).select("stratum", "x.*")
    counts = counts.groupBy("stratum", "rule", "step", "cutoff").agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    share = alpha / len(rules)
    strata = counts.select(F.countDistinct("stratum").alias("strata"))
    tested = counts.crossJoin(F.broadcast(strata))  # one row
    tested = tested.withColumn("p", F.expr(_tail("n", "k", share))).withColumn("passes", F.expr(f"p <= {delta}D / (strata * {len(rules)})"))
    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    certified = tested.withColumn("certified", F.min("passes").over(walk)).where("certified")
    best = certified.groupBy("stratum", "rule").agg(F.max(F.struct("step", "cutoff", "n", "k", "p")).alias("x"))
    return best.select("stratum", "rule", "x.cutoff", "x.n", "x.k", "x.p")


def _limits(measured: DataFrame, labels: DataFrame, rules: dict, alpha: float, delta: float) -> DataFrame:
    """One row per stratum that has a certified cutoff, one column per rule; written, so that its size is known to joins."""
    chosen = cutoffs(measured, labels, rules=rules, alpha=alpha, delta=delta)
    return materialize(chosen.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_{r}") for r in rules)), "cutoffs")


def _verdict(measured: DataFrame, limits: DataFrame, rules: dict) -> DataFrame:
    rejects = " OR ".join(f"coalesce(({v}) > _{r}, false)" for r, (v, _) in rules.items())
    return measured.join(limits, "stratum", "left").withColumn("base_failed", F.expr(BASE)).withColumn("kept", F.expr(f"NOT base_failed AND NOT ({rejects})"))


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row.

    Null and empty texts fail the base. Null languages are a stratum of their own. An empty table gives an empty
    table, empty labels leave the base rules alone. Ids may be null or repeat: each row stands for itself.
    """
    measured = materialize(measures(docs, id_col=id_col, text_col=text_col), "measures")
    out = _verdict(measured, _limits(measured, labels, rules, alpha, delta), rules)
    return out.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: dict = RULES, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of `docs`, whole, that judge() keeps.

    Rows are written once with their measures, which serve both the cutoffs and the verdicts: texts are measured
    once and never shuffled, at any size.
    """
    measured = materialize(measures(docs, id_col=id_col, text_col=text_col, whole=True), "measured")
    return _verdict(measured, _limits(measured.drop("_row"), labels, rules, alpha, delta), rules).where("kept").select("_row.*")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _oracle() -> str:
    share = ALPHA / len(RULES)
    grid = ", ".join(f"('{r}', {k}, CAST({c} AS DOUBLE))" for r, (_, g) in RULES.items() for k, c in enumerate(g))
    value = " ".join(f"WHEN '{r}' THEN {v}" for r, (v, _) in RULES.items())
    rejects = " OR ".join(f"coalesce({v} > (SELECT cutoff FROM best b WHERE b.stratum = m.stratum AND b.rule = '{r}'), false)" for r, (v, _) in RULES.items())
    space = "[ \\t-\\r]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
s AS (SELECT n, doc_id, stratum, t, regexp_extract_all(t, '[^ \\t-\\r]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS l FROM d),
g AS (SELECT n, unnest(generate_series(1, len(w) - 2)) AS i, w FROM s WHERE len(w) > 2),
h AS (SELECT n, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM g),
f AS (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS k FROM h),
p AS (SELECT n, count(DISTINCT i + o) AS n_repeat_words FROM f, (VALUES (0), (1), (2)) v(o) WHERE k > 1 GROUP BY n),
m AS (
  SELECT n, doc_id, stratum, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_bangs,
    length(t) - length(regexp_replace(t, '[{CAPITALS}]', '', 'g')) AS n_capitals, len(l) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN p USING (n)
), good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM m WHERE NOT {BASE} AND doc_id IN (SELECT doc_id FROM good)),
grid(rule, step, cutoff) AS (VALUES {grid}),
c AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER ((CASE rule {value} END) > cutoff) AS k
  FROM held, grid GROUP BY ALL
), t AS (
  SELECT *, CASE WHEN k > n * {share} THEN 1 ELSE list_sum(list_transform(generate_series(0, k), lambda i:
    exp(CASE WHEN i IN (0, n) THEN 0 ELSE lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) END + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS p,
    (SELECT count(DISTINCT stratum) FROM c) AS strata FROM c
), z AS (SELECT *, min(CAST(p <= {DELTA} / (strata * {len(RULES)}) AS INTEGER)) OVER (PARTITION BY stratum, rule ORDER BY step) AS ok FROM t),
best AS (SELECT stratum, rule, arg_max(cutoff, step) AS cutoff FROM z WHERE ok = 1 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed, NOT {BASE} AND NOT ({rejects}) AS kept FROM m
"""


OP7_SQL = _oracle()
