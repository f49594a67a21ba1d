"""Personal data by bootstrapped contextual extraction. Native: DataFrame and SQL functions only.

Entities that fixed patterns recognize (e-mail addresses, IP addresses, card and phone numbers) are the seeds. The words
around them are lexical patterns: the two words before, the words on both sides, a label before. Patterns and the
values that stand in them form a graph, which is scored in rounds: a pattern is as good for a kind as the share
of its values known to be of that kind, smoothed, and a value is as good as the best pattern that holds it.
Patterns above a bar then take in values that merely have the shape of the kind, such as phone numbers without a plus,
and these count in the next round. Values known from elsewhere are found in any spelling and context.

Texts are read once and never shuffled: what travels is one narrow row for each entity or candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, spare, table, text_or_empty

#: The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Java's form is possessive and starts where a run starts, so that no text takes time beyond its length.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_RUN = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
JAVA = {
    "email": _RUN + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PATTERNS["phone"],
}
#: Candidates: addresses with @ or a bracketed "at", colon-separated hexadecimal numbers, digits with separators.
_AT, _DOT = r"\x20?[\[({]\x20?(?:at|AT|@)\x20?[\])}]\x20?", r"\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?"
_ADDRESS = r"@|[\[({]\x20?(?:at|AT)"
_HEX = r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}"
CANDIDATE = rf"[A-Za-z0-9._%+-]+(?:@|{_AT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)*|{_HEX}|[+(]{{0,2}}[0-9](?:[\x20().-]{{0,2}}[0-9])+"
JAVA_CANDIDATE = rf"{_RUN}[A-Za-z0-9._%+-]++(?:@|{_AT})[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)*+|{_HEX}|[+(]{{0,2}}[0-9](?:[\x20().-]{{0,2}}[0-9])++"
#: Characters of context on each side, rounds of scoring, the bar for patterns (millionths), the weight of a value of unknown
#: kind and the smoothing (in values): a pattern whose values are all of one kind needs eight of them.
WINDOW, ROUNDS, BAR, UNKNOWN, SMOOTH = 64, 3, 800_000, 0.2, 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINE, _EDGE = "¶", "#"
_PIECES = 512


def _sums(a: str) -> str:
    return f"aggregate({a}, struct(0 AS s, cast(array() AS array<int>) AS a), (acc, x) -> struct(acc.s + x AS s, array_append(acc.a, acc.s + x) AS a), acc -> acc.a)"


def _running(a: str) -> str:
    """SQL for the running sums of an array of ints; long ones in pieces, for each step copies what it has so far."""
    total = "aggregate(c, 0, (acc, x) -> acc + x)"
    pieces = f"transform(sequence(0, (size({a}) - 1) div {_PIECES}), k -> slice({a}, k * {_PIECES} + 1, {_PIECES}))"
    heads = _sums(f"transform({pieces}, c -> {total})")
    long = f"flatten(zip_with({pieces}, {heads}, (c, h) -> transform({_sums('c')}, x -> x + h - {total})))"
    return f"CASE WHEN size({a}) = 0 THEN cast(array() AS array<int>) WHEN size({a}) <= {_PIECES} THEN {_sums(a)} ELSE {long} END"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '')"


_LUHN = "aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring(d, -i, 1) AS int) ELSE get(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring(d, -i, 1) AS int)) END) % 10 = 0"
_VALID = {
    "email": "true",
    "ip": r"regexp_like(x.v, r'^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$')",
    "card": f"exists(filter(array({_digits('x.v')}), d -> length(d) BETWEEN 12 AND 19), d -> {_LUHN})",
    "phone": f"length({_digits('x.v')}) BETWEEN 9 AND 15",
}
_GATE = {"email": "contains({t}, '@')", "ip": "contains({t}, '.')", "card": "true", "phone": "contains({t}, '+')", "any": r"regexp_like({t}, r'[0-9@]|[\[({{]\x20?(?:at|AT)\x20?[\])}}]')"}


def found(docs: DataFrame, row: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row, *keep, base, cands): arrays of spans s, e (code points), k (place in KINDS; -1), v (the text), l and r (what stands
    around), first and last (no other match on that side)."""
    rows, names = docs, {}
    for kind, pattern in (*JAVA.items(), ("any", JAVA_CANDIDATE)):
        m, p, g, ends = spare(rows, f"m_{kind}", f"p_{kind}", f"g_{kind}", f"e_{kind}")
        gate = _GATE[kind].format(t=f"`{text}`")
        rows = rows.withColumn(m, F.expr(f"CASE WHEN {gate} THEN regexp_extract_all(`{text}`, {_quoted(pattern)}, 0) ELSE cast(array() AS array<string>) END"))
        rows = rows.withColumn(p, F.expr(f"CASE WHEN size({m}) > 0 THEN split(`{text}`, {_quoted(pattern)}, -1) ELSE cast(array() AS array<string>) END"))
        names[kind] = (m, p, g, ends)
    # only what is near a match is kept of the pieces between them
    for m, p, g, _ in names.values():
        rows = rows.withColumn(g, F.expr(f"transform({m}, (x, i) -> length(x) + length(get({p}, i)))"))
        rows = rows.withColumn(p, F.expr(f"transform({p}, x -> struct(right(x, {WINDOW}) AS l, left(x, {WINDOW}) AS r))"))
    for _, _, g, ends in names.values():
        rows = rows.withColumn(ends, F.expr(_running(g)))
    spans = {}
    for n, (kind, (m, p, _, ends)) in enumerate(names.items()):
        k = n if kind in KINDS else -1
        spans[kind] = f"transform({m}, (x, i) -> struct(get({ends}, i) - length(x) AS s, {k} AS k, get({ends}, i) AS e, x AS v, get({p}, i).l AS l, get({p}, i + 1).r AS r, i = 0 AS first, i = size({m}) - 1 AS last))"
    base = ", ".join(f"filter({spans[k]}, x -> {_VALID[k]})" for k in KINDS)
    return rows.select(row, *keep, F.expr(f"array_sort(flatten(array({base})))").alias("base"), F.expr(f"filter({spans['any']}, {_plausible('x')})").alias("cands"))


def _plausible(x: str) -> str:
    """No digits that go on as a word, and a shape of some kind."""
    word = f"({x}.v RLIKE {_quoted(_ADDRESS)}) OR NOT ({x}.l RLIKE '[A-Za-z0-9]$' OR {x}.r RLIKE '^[A-Za-z0-9]')"
    return f"{x} -> ({word}) AND {_mask(f'{x}.v')} > 0"


def _plain(v: str) -> str:
    """A value's one spelling: digits alone, or an address in lower case with its signs back."""
    address = f"regexp_replace(regexp_replace(translate({v}, '{UPPER}', '{LOWER}'), {_quoted(_AT)}, '@'), {_quoted(_DOT)}, '.')"
    return f"CASE WHEN {v} RLIKE '[@:]|[A-Za-z]' THEN {address} WHEN {v} RLIKE r'^[0-9]+(?:\\.[0-9]+){{3}}$' THEN {v} ELSE {_digits(v)} END"


def _mask(v: str) -> str:
    """Bits of the kinds whose shape a candidate has."""
    n = f"length({_digits(v)})"
    return (
        f"CASE WHEN {v} RLIKE {_quoted(_ADDRESS)} THEN CASE WHEN {_plain(v)} RLIKE r'^[^@]++@[a-z0-9-]++(?:\\.[a-z0-9-]++)++$' THEN 1 ELSE 0 END"
        f" WHEN contains({v}, ':') THEN CASE WHEN {n} > 0 THEN 2 ELSE 0 END WHEN {v} RLIKE r'^[0-9]++(?:\\.[0-9]++){{3,}}+$' THEN 0"
        f" ELSE CASE WHEN {n} BETWEEN 12 AND 19 AND NOT {v} RLIKE '[+.]' THEN 4 ELSE 0 END + CASE WHEN {n} BETWEEN 7 AND 15 THEN 8 ELSE 0 END END"
    )


def _words(window: Column) -> Column:
    """Words of a context: A-Z lower-cased, digits as one zero, line ends as words of their own."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(window, UPPER, LOWER), "[0-9]+", "0"), "\n", f" {_LINE} ")
    return F.filter(F.split(plain, r"[ \t\r\x0b\f]+"), lambda w: w != "")


def occurrences(spans: DataFrame, row: str) -> DataFrame:
    """(row, s, e, kind, free, mask, value, patterns): each base entity and candidate; `free` candidates overlap no base entity."""
    one = spans.select(row, F.explode(F.expr("concat(base, cands)")).alias("x")).select(row, "x.*")
    edge = lambda at: F.when(F.col(at), F.lit(_LINE)).otherwise(F.lit(_EDGE))
    # an edge stands only where the window reaches it
    before = _words(F.right(F.concat(edge("first"), F.lit(" "), F.col("l")), F.lit(WINDOW)))
    after = _words(F.left(F.concat(F.col("r"), F.lit(" "), edge("last")), F.lit(WINDOW)))
    one = one.withColumn("w", before).withColumn("r1", F.coalesce(F.get(after, F.lit(0)), F.lit("")))
    one = one.withColumn("l1", F.coalesce(F.expr("get(w, size(w) - 1)"), F.lit(""))).withColumn("l2", F.coalesce(F.expr("get(w, size(w) - 2)"), F.lit("")))
    label = F.when(F.col("l1").rlike("[a-z].*[:=]$"), F.concat(F.lit("C "), "l1"))
    patterns = F.array_compact(F.array(F.concat(F.lit("L "), "l2", F.lit(" "), "l1"), F.concat(F.lit("M "), "l1", F.lit(" _ "), "r1"), label))
    base, here = F.col("k") >= 0, Window.partitionBy(row)
    ahead = F.max(F.when(base, F.col("e"))).over(here.orderBy("s", F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(base, F.col("s"))).over(here.orderBy(F.col("s").desc(), F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0))
    one = one.select(row, "s", "e", F.col("k").alias("kind"), F.expr(_plain("v")).alias("value"), F.when(base, F.lit(0)).otherwise(F.expr(_mask("v"))).alias("mask"), patterns.alias("patterns"), ahead.alias("ahead"), behind.alias("behind"))
    base = F.col("kind") >= 0
    free = ~base & ~F.coalesce(F.col("ahead") > F.col("s"), F.lit(False)) & ~F.coalesce(F.col("behind") < F.col("e"), F.lit(False))
    return one.withColumn("free", free).where(free | base).drop("ahead", "behind")


_C = [f"c{k}" for k in range(len(KINDS))]


def scored(seen: DataFrame, *, rounds: int = ROUNDS, bar: int = BAR) -> DataFrame:
    """(value, c0 ... c3): values with a score in millionths for each kind, from the graph of patterns and values.

    Seeds have 1,000,000 for their kinds throughout. Copies of a text count once: edges are distinct.
    """
    bit = F.expr("CASE WHEN kind >= 0 THEN shiftleft(1, kind) ELSE 0 END")
    edges = materialize(seen.select(F.explode("patterns").alias("pattern"), "value", "mask").groupBy("pattern", "value").agg(F.bit_or("mask").alias("mask")), "edges")
    seeds = seen.groupBy("value").agg(F.bit_or(bit).alias("k")).where("k > 0")
    seeds = materialize(seeds.select("value", *(F.when(F.col("k").bitwiseAND(F.lit(1 << n)) > 0, F.lit(1_000_000)).otherwise(F.lit(0)).cast("long").alias(c) for n, c in enumerate(_C))), "seeds")
    known = seeds
    for n in range(rounds):
        met = edges.join(known, "value", "left").groupBy("pattern").agg(*(F.sum(F.coalesce(c, F.lit(0).cast("long"))).alias(c) for c in _C), F.count_if(F.col(_C[0]).isNull()).alias("unknown"))
        best = F.expr("array_max(array(" + ", ".join(f"struct({c} AS c, {-k} AS k)" for k, c in enumerate(_C)) + "))")
        share = F.floor(F.col("best.c") * F.lit(1e6) / (F.expr(" + ".join(_C)) + F.col("unknown") * F.lit(UNKNOWN * 1e6) + F.lit(SMOOTH * 1e6)))
        good = materialize(met.withColumn("best", best).select("pattern", (-F.col("best.k")).alias("kind"), share.cast("long").alias("score")).where(F.col("score") >= bar), f"patterns{n}")
        taken = edges.join(good, "pattern").where("mask & shiftleft(1, kind) > 0").groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("x"))
        new = taken.join(seeds.select("value"), "value", "left_anti").select("value", *(F.when(F.col("x.k") == -k, F.col("x.score")).otherwise(F.lit(0)).cast("long").alias(c) for k, c in enumerate(_C)))
        known = materialize(seeds.unionByName(new), f"values{n}")
    return known


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, bar: int = BAR) -> DataFrame:
    """(doc_id, base, spans) of each row: arrays of start, kind (place in KINDS) and end in code points, in order.

    `base` are the valid matches of PATTERNS, leftmost and non-overlapping in each kind; `spans` adds what the contexts
    tell, never over a base entity. Null and empty texts have none; ids may be null or repeat, each row stands for
    itself; an empty table gives an empty one. Columns other than id and text are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    spans = materialize(found(rows, "row", "text", ("doc_id",)), "spans")
    seen = materialize(occurrences(spans.where("size(base) + size(cands) > 0"), "row"), "occurrences")
    known = scored(seen, rounds=rounds, bar=bar)
    fits = F.expr("array_max(array(" + ", ".join(f"CASE WHEN mask & {1 << k} > 0 AND {c} > 0 THEN struct({c} AS c, {-k} AS k) END" for k, c in enumerate(_C)) + "))")
    added = seen.where("free").join(known, "value").withColumn("best", fits).where("best IS NOT NULL")
    added = added.groupBy("row").agg(F.collect_list(F.struct(F.col("s").alias("start"), (-F.col("best.k")).alias("kind"), F.col("e").alias("end"))).alias("added"))
    base = F.transform("base", lambda x: F.struct(x["s"].alias("start"), x["k"].alias("kind"), x["e"].alias("end")))
    out = spans.select("row", "doc_id", base.alias("base")).join(added, "row", "left")
    return out.select(F.col("doc_id").alias(id_col), "base", F.expr("CASE WHEN added IS NULL THEN base ELSE array_sort(concat(base, added)) END").alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """`text` with each span in place of which [kind] stands; of overlapping spans one that starts later is left to the first."""
    name = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.get(name, x["kind"])).alias("out"), x["end"].alias("at")))
    return F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(table(spark, sf_dir, "documents"))
    counts = (F.expr(f"cast(size(filter(base, x -> x.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS))
    return out.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _oracle() -> str:
    digits = lambda v: f"regexp_replace({v}, '[^0-9]', '', 'g')"
    octet = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    address = f"regexp_replace(regexp_replace(translate(v, '{UPPER}', '{LOWER}'), '{_AT}', '@', 'g'), '{_DOT}', '.', 'g')"
    plain = f"CASE WHEN regexp_matches(v, '[@:]|[A-Za-z]') THEN {address} WHEN regexp_full_match(v, '[0-9]+([.][0-9]+){{3}}') THEN v ELSE {digits('v')} END"
    odd = r"regexp_matches(v, '@|[A-Za-z].*[\[({]')"
    words = lambda w: rf"list_filter(string_split_regex(replace(regexp_replace(translate({w}, '{UPPER}', '{LOWER}'), '[0-9]+', '0', 'g'), chr(10), ' {_LINE} '), '[ \t\r\x0b\f]+'), lambda x: x <> '')"
    lists = " UNION ALL ".join(f"SELECT n, {k} AS k, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM d" for k, p in [*enumerate(PATTERNS.values()), (-1, CANDIDATE)])
    sums, rounds, last = ", ".join(f"sum(coalesce({c}, 0)) AS {c}" for c in _C), "", "seeds"
    for n in range(ROUNDS):
        share = f"CAST(floor(CAST(greatest({', '.join(_C)}) AS DOUBLE) * 1e6 / (CAST({' + '.join(_C)} AS DOUBLE) + unknown * CAST({UNKNOWN * 1e6} AS DOUBLE) + {SMOOTH * 1e6:.0f})) AS BIGINT)"
        rounds += f"""
g{n} AS (SELECT pattern, {sums}, count(*) FILTER (c0 IS NULL) AS unknown FROM edges LEFT JOIN {last} USING (value) GROUP BY pattern),
p{n} AS (SELECT pattern, list_position([{", ".join(_C)}], greatest({", ".join(_C)})) - 1 AS kind, {share} AS score FROM g{n} WHERE {share} >= {BAR}),
t{n} AS (SELECT value, max(score * 10 + 9 - kind) AS x FROM edges JOIN p{n} USING (pattern) WHERE (mask >> kind) & 1 = 1 AND value NOT IN (SELECT value FROM seeds) GROUP BY value),
v{n} AS (SELECT * FROM seeds UNION ALL SELECT value, {", ".join(f"CASE WHEN x % 10 = {9 - k} THEN x // 10 ELSE 0 END" for k in range(4))} FROM t{n}),"""
        last = f"v{n}"
    fits = [f"CASE WHEN mask & {1 << k} > 0 THEN {c} ELSE 0 END" for k, c in enumerate(_C)]
    named = "CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents), lists AS ({lists}),
one AS (SELECT n, k, m, p, unnest(range(1, len(m) + 1)) AS i FROM lists WHERE len(m) > 0),
two AS (SELECT n, k, i, len(m) AS total, m[i] AS v, right(p[i], {WINDOW}) AS l, left(p[i + 1], {WINDOW}) AS r, CAST(sum(length(p[i]) + length(m[i])) OVER (PARTITION BY n, k ORDER BY i) AS BIGINT) AS e FROM one),
three AS (SELECT *, e - length(v) AS s, {digits("v")} AS dd, {plain} AS value,
  {words(f"right(CASE WHEN i = 1 THEN '{_LINE}' ELSE '{_EDGE}' END || ' ' || l, {WINDOW})")} AS w, coalesce({words(f"left(r || ' ' || CASE WHEN i = total THEN '{_LINE}' ELSE '{_EDGE}' END, {WINDOW})")}[1], '') AS r1 FROM two),
four AS (SELECT *, coalesce(w[-1], '') AS l1, coalesce(w[-2], '') AS l2,
  CASE WHEN {odd} THEN CASE WHEN regexp_full_match(value, '[^@]+@[a-z0-9-]+([.][a-z0-9-]+)+') THEN 1 ELSE 0 END
    WHEN contains(v, ':') THEN CASE WHEN dd <> '' THEN 2 ELSE 0 END WHEN regexp_full_match(v, '[0-9]+([.][0-9]+){{3,}}') THEN 0
    ELSE CASE WHEN length(dd) BETWEEN 12 AND 19 AND NOT regexp_matches(v, '[+.]') THEN 4 ELSE 0 END + CASE WHEN length(dd) BETWEEN 7 AND 15 THEN 8 ELSE 0 END END AS shape,
  CASE k WHEN 0 THEN true WHEN 1 THEN regexp_full_match(v, '{octet}([.]{octet}){{3}}') WHEN 3 THEN length(dd) BETWEEN 9 AND 15
    WHEN 2 THEN length(dd) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(dd) + 1), lambda j: CASE WHEN j % 2 = 1 THEN CAST(dd[-j] AS INTEGER) ELSE 2 * CAST(dd[-j] AS INTEGER) - CASE WHEN CAST(dd[-j] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE {odd} OR NOT (regexp_matches(l, '[A-Za-z0-9]$') OR regexp_matches(r, '^[A-Za-z0-9]')) END AS valid FROM three),
five AS (SELECT n, k AS kind, s, e, value, CASE WHEN k < 0 THEN shape ELSE 0 END AS mask, [x FOR x IN ['L ' || l2 || ' ' || l1, 'M ' || l1 || ' _ ' || r1, CASE WHEN regexp_matches(l1, '[a-z].*[:=]$') THEN 'C ' || l1 END] IF x IS NOT NULL] AS patterns FROM four WHERE valid AND (k >= 0 OR shape > 0)),
seen AS (SELECT * FROM five a WHERE kind >= 0 OR NOT EXISTS (FROM five b WHERE b.kind >= 0 AND b.n = a.n AND b.s < a.e AND b.e > a.s)),
edges AS (SELECT pattern, value, bit_or(mask) AS mask FROM (SELECT unnest(patterns) AS pattern, value, mask FROM seen) GROUP BY ALL),
seeds AS (SELECT value, {", ".join(f"CASE WHEN bool_or(kind = {k}) THEN 1000000 ELSE 0 END AS {c}" for k, c in enumerate(_C))} FROM seen WHERE kind >= 0 GROUP BY value),{rounds}
fits AS (SELECT n, s, e, [{", ".join(fits)}] AS f FROM seen JOIN {last} USING (value) WHERE kind < 0),
added AS (SELECT n, s, list_position(f, list_max(f)) - 1 AS kind, e FROM fits WHERE list_max(f) > 0),
base AS (SELECT n, s, kind, e FROM seen WHERE kind >= 0),
b AS (SELECT n, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{name}" for k, name in enumerate(KINDS))}, string_agg({named}, ',' ORDER BY s, kind, e) AS listed FROM base GROUP BY n),
a AS (SELECT n, string_agg({named}, ',' ORDER BY s, kind, e) AS spans FROM (FROM base UNION ALL FROM added) GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name in KINDS)}, sha256(coalesce(listed, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN b USING (n) LEFT JOIN a USING (n)
"""


OP11_SQL = _oracle()
