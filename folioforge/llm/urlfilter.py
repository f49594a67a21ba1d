"""URL rules indexed by their rarest literal token. Native: DataFrame functions only.

Each rule is a regular expression with the literal tokens (letter and digit runs) that any matching URL holds. How
often these tokens occur is counted over all URLs, each rule is filed under its rarest one, and a URL's tokens
fetch the rules filed under them; only those are tried as regular expressions. Rules without a token are always tried.
Few rules stand in the expression itself; any number of them is a table, which URLs meet in a join on tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, spare, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above this many rules, tokens fetch them by a join; below, from a map held in the expression. Rules without a token, which
#: every URL tries, stand in expressions of about so many; after so many expressions the rows are written.
INLINE_RULES, WRITTEN_AFTER = 200, 8
#: URLs that meet the rules of one token in one task, about.
ROWS_PER_SALT = 1_000_000
RULES = "name string, action string, pattern string, tokens array<string>, weight int, host boolean"


@dataclass(frozen=True)
class Rule:
    """`pattern` is searched in host + path; each of `tokens` is a whole token of every match.

    Of fitting `host` rules the one of highest `weight` decides, of others the first by name.
    """

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int = 0
    host: bool = False


def host_rule(action: str, rule: str) -> Rule:
    """A rule like example.com/en/: the host and all subdomains, paths that start with /en/; longer ones win.

    A token at the end of the path counts only if a mark follows it: else the URL's token may go on.
    """
    host, _, path = rule.partition("/")
    tokens = re.findall("[a-z0-9]+", f"{host}/".lower()) + [t.lower() for t in re.findall("[A-Za-z0-9]+(?=[^A-Za-z0-9])", f"/{path}")]
    return Rule(rule, action, rf"(?s)^(?:[^/]*\.)?{_java(host)}/{_java(path)}", tuple(dict.fromkeys(tokens)), len(rule), True)


def _java(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/])", r"\\\1", text)


def word_rule(word: str) -> Rule:
    """Block URLs that hold `word` (its parts joined by -) as tokens of host or path."""
    return Rule(f"word:{word}", "block", rf"(?i)(?:^|[^a-z0-9]){_java(word)}(?:[^a-z0-9]|$)", tuple(re.findall("[a-z0-9]+", word)))


HOST_RULES = (host_rule("allow", "com/"), host_rule("block", "example.com/en/"), host_rule("allow", "www.example.com/en/"), host_rule("block", "net/es/"), host_rule("block", "net/fr/"))
#: Words of hosts and paths whose pages are left out.
WORDS = ("spam-farm", "link-farm", "ads-track", "casino", "poker", "betting", "viagra", "cialis", "porn", "xxx", "escort", "warez", "torrent", "phishing", "malware")
WORD_RULES = tuple(word_rule(w) for w in WORDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")
    path = F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0)))


def rarest(rules: tuple[Rule, ...], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Rule numbers by the token that they are filed under (None: always tried)."""
    out: dict[str | None, list[int]] = {}
    for n, r in enumerate(rules):
        out.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=None), []).append(n)
    return out


def _best(found: Column) -> tuple[Column, Column]:
    """Of an array of rules found, the deciding host rule and the deciding other one."""
    longest = F.array_max(F.transform(F.filter(found, lambda r: r["host"]), lambda r: F.struct(r["weight"].alias("w"), r["name"].alias("name"), r["action"].alias("action"))))
    first = F.array_min(F.transform(F.filter(found, lambda r: ~r["host"]), lambda r: F.struct(r["name"].alias("name"), r["action"].alias("action"))))
    return longest, first


def _tried(rules: tuple[Rule, ...], fetched: Column, text: Column) -> Column:
    """The rules (without their patterns) of `fetched`, and of `rules` themselves, that are found in `text`."""
    tried = F.filter(F.concat(_structs(rules), fetched) if rules else fetched, lambda r: F.regexp_like(text, r["pattern"]))
    return F.transform(tried, lambda r: r.dropFields("pattern"))


def _structs(rules: tuple[Rule, ...]) -> Column:
    fields = ("name", "action", "weight", "host", "pattern")
    return F.array(*(F.struct(*(F.lit(getattr(r, f)).alias(f) for f in fields)) for r in rules)).cast("array<struct<name:string,action:string,weight:int,host:boolean,pattern:string>>")


def _free(urls: DataFrame, out: tuple[str, str]) -> None:
    clash = {c.lower() for c in out} & {c.lower() for c in urls.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")


def matched(urls: DataFrame, rules: tuple[Rule, ...], text_col: str, *, out: tuple[str, str] = ("_rule", "_other")) -> DataFrame:
    """`urls` with two columns more, named by `out`: the deciding host rule and the deciding other one found in `text_col`, null
    where there is none and for null texts. The rules stand in the expression. Names that are taken are an error."""
    _free(urls, out)
    (hits,) = spare(urls, "hits")
    known = sorted({t for r in rules for t in r.tokens})
    there = urls.select(F.explode(F.array_intersect(tokens_of(F.col(text_col)), F.array(*map(F.lit, known)))).alias("t")) if known else None
    counts = {r["t"]: r["n"] for r in there.groupBy("t").agg(F.count("*").alias("n")).collect()} if known else {}  # one row per token of a rule
    filed = rarest(rules, counts)
    always = tuple(rules[n] for n in filed.pop(None, []))
    fetched = _structs(())
    if filed:
        index = F.create_map(*(x for t, ns in filed.items() for x in (F.lit(t), _structs(tuple(rules[n] for n in ns)))))
        fetched = F.flatten(F.transform(F.array_intersect(tokens_of(F.col(text_col)), F.array(*map(F.lit, filed))), lambda t: F.element_at(index, t)))
    rows = urls.withColumn(hits, _tried(always, fetched, F.col(text_col)))
    longest, first = _best(F.col(hits))
    return rows.select(*urls.columns, longest.alias(out[0]), first.alias(out[1]))


def matched_by_table(urls: DataFrame, rules: DataFrame, text_col: str, *, out: tuple[str, str] = ("_rule", "_other")) -> DataFrame:
    """As matched(), with the rules a table of RULES that the driver never sees whole.

    Tokens travel with the number of their URL's row alone, and what they fetch goes back to the text in one join. A token of many
    URLs is dealt over salts, to each of which the rules filed under it go; repeated URLs are no hot key. Null tokens of a
    rule count for nothing; rules without a token are tried on every URL, block by block. A null pattern matches nothing.
    """
    _free(urls, out)
    n, best_host, best_other = spare(urls, "n", "host", "other")
    rows = materialize(urls.withColumn(n, F.monotonically_increasing_id()), "urls")
    text = rows.select(F.col(n).alias("n"), F.col(text_col).alias("text"))
    held = rules.where("pattern IS NOT NULL").select("name", "action", "pattern", F.coalesce("weight", F.lit(0)).alias("weight"), F.coalesce("host", F.lit(False)).alias("host"), F.filter(F.coalesce("tokens", F.array().cast("array<string>")), lambda t: t.isNotNull()).alias("tokens"))
    met = text.select("n", F.explode(tokens_of(F.col("text"))).alias("t"))
    filed = held.where("size(tokens) > 0")
    names = filed.select(F.explode("tokens").alias("t")).distinct()
    counts = materialize(names.join(met.groupBy("t").agg(F.count("*").alias("k")), "t", "left").select("t", F.coalesce("k", F.lit(0)).alias("k")), "tokens")
    one = filed.select(F.struct("name", "action", "pattern", "weight", "host").alias("r"), F.explode("tokens").alias("t")).join(counts, "t")
    filed = one.groupBy("r").agg(F.min(F.struct("k", "t")).alias("x")).select("x.t", "x.k", "r.*")
    salts = F.ceil((F.col("k") + 1) / ROWS_PER_SALT).cast("int")
    filed = materialize(filed.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))), "filed")
    dealt = met.join(filed.select("t", salts.alias("salts")).distinct(), "t").select("n", "t", F.pmod(F.xxhash64("n"), "salts").cast("int").alias("salt"))
    hits = dealt.join(filed, ["t", "salt"]).select("n", "name", "action", "pattern", "weight", "host").join(text, "n").where(F.regexp_like("text", F.col("pattern")))
    best = hits.groupBy(F.col("n").alias(f"{n}_")).agg(
        F.max(F.when(F.col("host"), F.struct(F.col("weight").alias("w"), "name", "action"))).alias(best_host), F.min(F.when(~F.col("host"), F.struct("name", "action"))).alias(best_other)
    )
    done = rows.join(best, F.col(n) == F.col(f"{n}_"), "left").drop(f"{n}_", n)
    free = materialize(held.where("size(tokens) = 0").drop("tokens"), "tokenless")
    blocks = -(-free.count() // INLINE_RULES)
    for k in range(blocks):
        mine = free.where(F.pmod(F.xxhash64("name", "pattern"), F.lit(blocks)) == k).collect()  # INLINE_RULES, about
        found = _tried(tuple(Rule(r["name"], r["action"], r["pattern"], (), r["weight"], r["host"]) for r in mine), _structs(()), F.col(text_col))
        (tried,) = spare(done, "tried")
        longest, first = _best(F.col(tried))
        done = done.withColumn(tried, found).withColumns({best_host: F.greatest(best_host, longest), best_other: F.least(best_other, first)}).drop(tried)
        if k % WRITTEN_AFTER == WRITTEN_AFTER - 1:
            done = materialize(done, f"tried{k}")
    return done.select(*urls.columns, F.col(best_host).alias(out[0]), F.col(best_other).alias(out[1]))


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] | DataFrame = HOST_RULES + WORD_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) for each row. `rules`: Rule tuples, or a table of RULES of any size.

    The longest fitting host rule decides; without one, the first other rule by name; without either the page is
    allowed. Null, empty and malformed URLs have empty host and path, fit no rule and are allowed. Every row stands for
    itself, ids may be null or repeat; columns other than the two named are not read.
    """
    host, path = split_url(F.col("_url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("_url")).select("page_id", host.alias("host"), path.alias("path"), F.concat(host, path).alias("_text"))
    if isinstance(rules, tuple) and len(rules) > INLINE_RULES:
        rules = pages.sparkSession.createDataFrame([(r.name, r.action, r.pattern, list(r.tokens), r.weight, r.host) for r in rules], RULES)
    rows = matched(rows, rules, "_text") if isinstance(rules, tuple) else matched_by_table(rows, rules, "_text")
    return rows.select(F.col("page_id").alias(id_col), "host", "path", F.col("_rule.name").alias("rule"), F.coalesce("_rule.action", "_other.action", F.lit("allow")).alias("verdict"), F.col("_other.name").alias("pattern_rule"))


def op9_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_RULES = ", ".join(f"('{r.name}', '{r.action}', '{r.name.split('/', 1)[0]}', '/{r.name.split('/', 1)[1]}')" for r in HOST_RULES)
_WORD_RULES = ", ".join(f"('{r.name}', '(?:^|[^a-z0-9]){w}(?:[^a-z0-9]|$)')" for r, w in zip(WORD_RULES, WORDS, strict=True))
OP9_SQL = f"""
WITH r(name, action, rhost, rpath) AS (VALUES {_RULES}), w(name, pattern) AS (VALUES {_WORD_RULES}),
u AS (
  SELECT page_id, row_number() OVER () AS n,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), '{UPPER}', '{LOWER}') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), hit AS (
  SELECT n, arg_max(name, length(name)) AS rule, arg_max(action, length(name)) AS action
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
), word AS (
  SELECT n, min(name) AS pattern_rule FROM u JOIN w ON regexp_matches(lower(host || path), pattern) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN pattern_rule IS NOT NULL THEN 'block' END, 'allow') AS verdict, pattern_rule
FROM u LEFT JOIN hit USING (n) LEFT JOIN word USING (n)
"""
