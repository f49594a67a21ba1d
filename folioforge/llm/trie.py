"""A prefix trie of conversations: which share their first turns, and what storing shared prefixes once would save.

A node is a distinct sequence of first turns; its key is the exclusive or of 128-bit hashes of its turns, each hashed
with its place. Nodes are pre-aggregated before anything is gathered, so repeated conversations cost nothing more.
Nodes with many turns below them are the heavy upper levels. What hangs below these are prefix shards of bounded
size: there numpy lays out a succinct level-order trie (a LOUDS bit vector and label arrays) and rolls values up in
reverse level order. The heavy levels are merged separately: every shard's totals count for the path of one
conversation that runs through it, and sums along paths, then over a node's conversations, give the rest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..cluster import map_arrow, ship
from .common import materialize, table

#: Turns below a node, repeated conversations included, above which it counts as heavy; also about what a shard holds.
SHARD_TURNS = 50_000
#: Turns of a conversation that one window takes; longer ones are summed block by block.
BLOCK = 10_000
#: Conversations of one hundred share up to SHARED - 1 first turns of the first of them.
HUNDRED, SHARED = 100, 6
KEY = ("depth", "h1", "h2")
NODE = "conv_id long, depth long, h1 long, h2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, p1 long, p2 long, top boolean"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _flip(c: str) -> Column:
    return F.col(c).bitwiseXOR(F.col(f"t{c[1]}"))


def numbered(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, total, role, m, len): turns by number (null first), then role, then MD5 of the text; pos from 1.

    Null roles and texts are empty, rows without a conversation are left out, repeated rows stay. Rows are sorted by
    conversation and turn over all tasks, so that a long conversation is dealt over many; only digests of texts travel.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.md5(text.cast("binary")).alias("m"), F.length(text).cast("long").alias("len"))
    ordered = rows.orderBy("conv", F.col("turn").asc_nulls_first(), "role", "m").withColumn("id", F.monotonically_increasing_id())
    ordered = materialize(ordered.withColumn("part", F.shiftright("id", 33)), "turns")
    parts = ordered.groupBy("conv", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy("conv")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = materialize(parts.select(F.col("conv").alias("c"), F.col("part").alias("p"), (before - F.col("first") + 1).alias("shift"), F.sum("n").over(whole).alias("total")), "parts")
    placed = ordered.join(parts, (ordered["conv"] == parts["c"]) & (ordered["part"] == parts["p"]))
    return materialize(placed.select("conv", (F.col("id") + F.col("shift")).alias("pos"), "total", "role", "m", "len"), "numbered")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (as numbered() gives them) of conversations whose first h turns are those of the first one of their hundred,
    h drawn by CRC-32 of the number, and (conv, total) of all conversations, those without turns included."""
    drawn = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    first = F.col("conv") - F.col("conv") % HUNDRED
    known = turns.where("pos = 1").select("conv", F.col("total").alias("own"), drawn.alias("h"), first.alias("base"))
    heads = turns.where((F.col("conv") % HUNDRED == 0) & (F.col("pos") < SHARED)).select(F.col("conv").alias("b"), "pos", F.col("total").alias("others"), "role", "m", "len")
    given = known.join(heads.where("pos = 1").select("b", "others"), F.col("base") == F.col("b"), "left")
    kept = F.least("h", F.coalesce("others", F.lit(0)))
    convs = materialize(given.select("conv", "base", "h", kept.cast("long").alias("kept"), (kept + F.greatest(F.col("own") - F.col("h"), F.lit(0))).cast("long").alias("total")), "conversations")
    theirs = convs.where("kept > 0").join(heads, (F.col("base") == F.col("b")) & (F.col("pos") <= F.col("kept"))).select("conv", "pos", convs["total"], "role", "m", "len")
    own = turns.drop("total").where(F.col("pos") > drawn).join(convs, "conv").select("conv", (F.col("pos") - F.col("h") + F.col("kept")).alias("pos"), "total", "role", "m", "len")
    return theirs.unionByName(own), convs.select("conv", "total")


def running(rows: DataFrame, values: dict[str, Column], how, plus, *, back: bool = False) -> DataFrame:
    """`rows` (conv, depth, total, ...) with `values` gathered by `how` from each conversation's start (or end) up to each row.

    Conversations of more than BLOCK turns are gathered within blocks, whose totals then come first.
    """
    rows = rows.withColumn("blk", F.floor(F.col("depth") / BLOCK))
    order = (lambda c: F.col(c).desc()) if back else F.col
    here = Window.partitionBy("conv", "blk").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.where(F.col("total") >= BLOCK).groupBy(F.col("conv").alias("c"), F.col("blk").alias("b")).agg(*(how(v).alias(f"o_{n}") for n, v in values.items()))
    over = Window.partitionBy("c").orderBy(order("b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.select("c", "b", *(how(f"o_{n}").over(over).alias(f"o_{n}") for n in values)), "blocks")
    near = rows.select("*", *(how(v).over(here).alias(f"n_{n}") for n, v in values.items()))
    out = near.join(offsets, (near["conv"] == offsets["c"]) & (near["blk"] == offsets["b"]), "left")
    return out.select(*(c for c in rows.columns if c != "blk" and c not in values), *(plus(F.col(f"n_{n}"), F.coalesce(f"o_{n}", F.lit(0))).alias(n) for n in values))


class Louds:
    """A forest in level order: `bits` holds a one for each child and a zero after each node's children, the first group the
    roots'; `labels` are the last turns' hashes; `order` are the rows that the nodes were made of."""

    def __init__(self, level: np.ndarray, parent: np.ndarray, labels: np.ndarray):
        n, self.levels = len(level), [0]
        place, orders = np.full(n, -1, np.int64), []
        by_level = np.argsort(level, kind="stable")
        cuts = np.searchsorted(level[by_level], np.arange(int(level.max()) + 2)) if n else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = by_level[a:b]
            above = np.where(parent[rows] < 0, -1, place[parent[rows]])
            rows = rows[np.lexsort((labels[rows, 1], labels[rows, 0], above))]
            place[rows] = np.arange(a, b)
            orders.append(rows)
            self.levels.append(int(b))
        self.order = np.concatenate(orders) if orders else np.zeros(0, np.int64)
        self.labels = labels[self.order]
        up = parent[self.order]
        degrees = np.bincount(np.where(up < 0, 0, place[up] + 1), minlength=n + 1)
        self.bits = np.ones(2 * n + 1, bool)
        self.bits[np.cumsum(degrees + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Each node's parent: the zeros before its one, less the roots' own; -1 for roots."""
        ones = np.flatnonzero(self.bits)
        return ones - np.arange(len(ones)) - 1

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def roll_up(self, *values: np.ndarray) -> None:
        """Adds every node's values to its parent's, from the last level up, in place."""
        parents = self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            for v in values:
                np.add.at(v, parents[a:b], v[a:b])


def _matched(keys: list[np.ndarray], wanted: list[np.ndarray]) -> np.ndarray:
    """For each of `wanted` the row of `keys`, all distinct, that is equal in every column; -1 without one."""
    n, columns = len(keys[0]), [np.concatenate(x) for x in zip(keys, wanted, strict=True)]
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    row = np.full(len(order), -1, np.int64)
    row[group[:n]] = np.arange(n)
    return row[group[n:]]


def shard_nodes(shard: pa.Table) -> pa.Table:
    """One prefix shard's nodes (NODE) from its rows conv_id, depth, above, h1, h2, t1, t2, n_convs, len."""
    col = {c: shard.column(c).to_numpy() for c in ("conv_id", "depth", "above", "h1", "h2", "t1", "t2", "n_convs", "len")}
    p1, p2 = col["h1"] ^ col["t1"], col["h2"] ^ col["t2"]
    level = col["depth"] - col["above"] - 1
    parent = np.where(level > 0, _matched([col["h1"], col["h2"], col["depth"]], [p1, p2, col["depth"] - 1]), -1)
    trie = Louds(level, parent, np.stack([col["t1"], col["t2"]], axis=1))
    o, up, children = trie.order, trie.parents(), trie.degrees()
    leaves, saved = (children == 0).astype(np.int64), ((col["n_convs"] - 1) * col["len"])[o]
    trie.roll_up(leaves, saved)
    conv = col["conv_id"][o]
    parents = pa.array(np.where(up < 0, 0, conv[up]), mask=up < 0)
    arrays = [conv, col["depth"][o], col["h1"][o], col["h2"][o], parents, col["n_convs"][o], children, leaves, saved, p1[o], p2[o], up < 0]
    return pa.table(dict(zip((c.split()[0] for c in NODE.split(", ")), map(pa.array, arrays), strict=True)))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(depth, h1, h2, sha) of conversations (conv, depth, h1, h2) that end at a node: SHA-256 of their numbers, comma-joined.

    Numbers come sorted and are hashed as they stream by: a node at which any number of conversations ends takes one batch
    of memory. A digest is a chain, so one node's numbers cannot be dealt over tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            conv, keys, out = batch.column("conv").to_numpy(), np.stack([batch.column(c).to_numpy() for c in KEY], axis=1), []
            cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(conv)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                key, text = tuple(keys[a].tolist()), ",".join(map(str, conv[a:b].tolist()))
                if key == last:
                    digest.update(f",{text}".encode())
                    continue
                if last is not None:
                    out.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256(text.encode())
            yield made(out)
        if last is not None:
            yield made([(*last, digest.hexdigest())])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=[*KEY, "sha"])

    dealt = ends.select("conv", *KEY).repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    return map_arrow(dealt, run, "depth long, h1 long, h2 long, sha string")


def prefix_trie(turns: DataFrame, convs: DataFrame, *, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node, as longs.

    `turns` as numbered() gives them, `convs` (conv, total) of all conversations. A node's conv_id is its smallest
    member. No conversations: no nodes, not even a root.
    """
    spark = turns.sparkSession
    tags = {f"t{k}": F.xxhash64(F.lit(k), F.col("pos"), F.col("role"), F.col("m")) for k in (1, 2)}
    rows = turns.select("conv", F.col("pos").cast("long").alias("depth"), "total", "len", *(v.alias(n) for n, v in tags.items()))
    rows = rows.withColumn("h1", F.col("t1")).withColumn("h2", F.col("t2"))
    rows = materialize(running(rows, {"h1": F.col("h1"), "h2": F.col("h2")}, F.bit_xor, lambda a, b: a.bitwiseXOR(b)), "paths")
    nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.max("t1").alias("t1"), F.max("t2").alias("t2"), F.max("len").alias("len"), F.sum(F.col("total") - F.col("depth") + 1).alias("below"))
    nodes = materialize(nodes, "nodes")
    # the heavy upper levels: nodes with much below them, and the root
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(*(zero.alias(c) for c in KEY), "n_convs", "conv_id", zero.alias("t1"), zero.alias("t2"), zero.alias("len"))
    upper = materialize(nodes.where(F.col("below") > shard_turns).drop("below").unionByName(root), "upper")
    upper_rows = rows.select("conv", "total", *KEY).join(upper.select(*KEY), [*KEY], "left_semi")
    upper_rows = materialize(upper_rows.unionByName(convs.select("conv", "total", *(zero.alias(c) for c in KEY))), "upper_paths")
    # each conversation's path leaves them once, for a shard's top
    last = upper_rows.groupBy("conv").agg(F.max("depth").alias("above"))
    tops = rows.select("conv", "depth", F.col("h1").alias("r1"), F.col("h2").alias("r2")).join(last, "conv").where("depth = above + 1").select("conv", "above", "r1", "r2")
    shards = max(1, math.ceil((nodes.agg(F.sum("n_convs")).first()[0] or 0) / shard_turns))
    light = nodes.where(F.col("below") <= shard_turns).join(tops, F.col("conv_id") == F.col("conv")).withColumn("shard", F.pmod(F.xxhash64("r1", "r2"), F.lit(shards)))
    ship(spark)
    lower = materialize(light.select("shard", "conv_id", "depth", "above", "h1", "h2", "t1", "t2", "n_convs", "len").groupBy("shard").applyInArrow(shard_nodes, NODE), "lower")
    # their own rollups
    parent = [_flip("h1").alias("p1"), _flip("h2").alias("p2")]
    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), *parent).select("depth", F.col("p1").alias("h1"), F.col("p2").alias("h2"))
    children = materialize(below.join(upper.select(*KEY), [*KEY], "left_semi").groupBy(*KEY).agg(F.count("*").alias("n_children")), "children")
    merged = upper.join(children, [*KEY], "left").withColumn("n_children", F.coalesce("n_children", zero))
    own = merged.select(F.col("conv_id").alias("conv"), "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved_tokens"))
    under = lower.where("top").select(F.col("conv_id").alias("conv"), (F.col("depth") - 1).alias("depth"), "n_leaves", "saved_tokens")
    gifts = own.unionByName(under).groupBy("conv", "depth").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    along = upper_rows.join(gifts, ["conv", "depth"], "left").fillna(0, ["n_leaves", "saved_tokens"])
    along = running(along, {"n_leaves": F.col("n_leaves"), "saved_tokens": F.col("saved_tokens")}, F.sum, lambda a, b: a + b, back=True)
    sums = along.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    merged = merged.join(sums, [*KEY]).select("conv_id", *KEY, F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", *parent, (F.col("depth") > 0).alias("top"))
    above = upper.select((F.col("depth") + 1).alias("d"), F.col("h1").alias("u1"), F.col("h2").alias("u2"), F.col("conv_id").alias("u"))
    out = lower.unionByName(merged)
    out = out.join(above, F.col("top") & (out["depth"] == above["d"]) & (out["p1"] == above["u1"]) & (out["p2"] == above["u2"]), "left")
    ends = rows.where("depth = total").select("conv", *KEY).unionByName(convs.where("total = 0").select("conv", *(zero.alias(c) for c in KEY)))
    out = out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "u")).join(ends_digests(ends), [*KEY], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard_turns: int = SHARD_TURNS) -> DataFrame:
    """prefix_trie() of conversations as they stand. Nulls: see numbered(); other columns are not read."""
    turns = numbered(conversations, conv_col=conv_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
    return prefix_trie(turns, turns.where("pos = 1").select("conv", "total"), shard_turns=shard_turns)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt(numbered(table(spark, sf_dir, "conversations"))))


#: CRC-32 of the ASCII digits in column `s`, bit by bit.
_CRC = "xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(s, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) for i in range(8)]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), k AS (SELECT DISTINCT conv, CAST(conv AS VARCHAR) AS s FROM t), c AS (SELECT conv, conv - conv % {HUNDRED} AS base, {_CRC} % {SHARED} AS h FROM k),
r AS (
  SELECT c.conv, 0 AS o, pos, role, text FROM c JOIN t ON t.conv = c.base AND pos <= h
  UNION ALL SELECT c.conv, 1, pos, role, text FROM c JOIN t ON t.conv = c.conv AND pos > h
), n AS (SELECT conv, row_number() OVER (PARTITION BY conv ORDER BY o, pos) AS depth, role, text FROM r),
l AS (SELECT conv, list(struct_pack(role := role, text := text) ORDER BY depth) AS seq FROM n GROUP BY conv),
s AS (SELECT c.conv, coalesce(len(seq), 0) AS total, seq FROM c LEFT JOIN l USING (conv)),
p AS (SELECT conv, total, unnest(range(total + 1)) AS depth, seq FROM s),
q AS (SELECT conv, total, depth, CASE WHEN depth = 0 THEN 'root' ELSE md5(CAST(seq[1:depth] AS VARCHAR)) || md5(to_json(seq[1:depth])) END AS key, CASE WHEN depth = 0 THEN 0 ELSE length(seq[depth].text) END AS len FROM p),
g AS (SELECT depth, key, min(conv) AS conv_id, count(*) AS n_convs, max(len) AS len, string_agg(CASE WHEN total = depth THEN CAST(conv AS VARCHAR) END, ',' ORDER BY conv) AS ends FROM q GROUP BY ALL),
e AS (SELECT DISTINCT a.depth, a.key, b.depth AS d2, b.key AS k2 FROM q a JOIN q b ON a.conv = b.conv AND b.depth >= a.depth),
kids AS (SELECT depth, key, count(*) AS n_children FROM e WHERE d2 = depth + 1 GROUP BY ALL),
up AS (SELECT e.d2 AS depth, e.k2 AS key, g.conv_id AS parent_conv_id FROM e JOIN g ON e.depth = g.depth AND e.key = g.key WHERE d2 = e.depth + 1),
sub AS (
  SELECT e.depth, e.key, sum((x.n_convs - 1) * x.len) AS saved_tokens, count(*) FILTER (kids.key IS NULL) AS n_leaves
  FROM e JOIN g x ON x.depth = e.d2 AND x.key = e.k2 LEFT JOIN kids ON kids.depth = e.d2 AND kids.key = e.k2 GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM g LEFT JOIN up USING (depth, key) LEFT JOIN kids USING (depth, key) JOIN sub USING (depth, key)
"""
