"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

Two fingerprints of 64 bits that differ in at most 4 bits differ in at most 4 of their 8 bytes, so they share at
least 4 bytes in place. A posting list per single positional byte would hold 1/256 of the corpus; the index is
therefore kept on the 20 byte triples of a covering design: every set of 4 positions contains at least one of
them, so each pair that reaches the 4 shared bytes meets in a list, and no other lists are needed. In a list the
shared positional bytes of each pair are tallied, pairs under the guaranteed minimum go, the rest are verified by
their differing bits. Long lists are keyed anew by a fourth byte, which every pair shares, and where that does not
part them by half bytes. Lists over `list_rows` are cut into blocks, and each pair of blocks is its own group; from
a group only the edges of a spanning forest leave, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..cluster import map_arrow
from .common import connected_components, materialize, scratch, spare, table, text_or_empty

NBYTES = 8
SEED = 42
_STEP = 1 << 18


def covering_triples() -> list[tuple[int, int, int]]:
    """20 of the 56 triples of 8 positions such that every 4 positions contain one of them.

    Positions fall in groups of 3, 3 and 2; taken are triples inside a group, and those with two positions in a
    group and one in the next.
    """
    groups = [[0, 1, 2], [3, 4, 5], [6, 7]]
    found = [t for g in groups for t in combinations(g, 3)]
    for k, g in enumerate(groups):
        found += [(*pair, x) for pair in combinations(g, 2) for x in groups[(k + 1) % 3]]
    return [tuple(sorted(t)) for t in found]


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, repeats included, in parts of bounded size; nothing for a wordless text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined, n, h = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= shingle:
        yield np.array([h(joined, SEED)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: n - shingle + 1], ends[shingle - 1 :]
    for k in range(0, len(starts), _STEP):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(starts[k : k + _STEP].tolist(), ends[k : k + _STEP].tolist(), strict=True)], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> int:
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprint(text: str | None, shingle: int) -> int:
    """Unsigned 64-bit SimHash of one text; see fingerprints()."""
    ones, total = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones, total = ones + _ones(h), total + len(h)
    return _majority(ones, total)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; empty for a wordless text."""
    parts = [np.unique(h) for h in shingle_hashes(text, shingle)]
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0] if parts else np.zeros(0, np.uint64)


def set_name(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set: texts with equal sets are one node."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes(), SEED), np.uint64).view(np.int64))


#: Positional bytes of a wide fingerprint: BANDS runs of BAND_ROWS, each byte the lowest of a MinHash of the shingle set. Two
#: texts share a byte with a chance of their Jaccard similarity (and 1/256 of the rest), so a pair at 0.8 shares no whole
#: run with a chance of (1 - 0.8^5)^14 = 0.4 %.
BAND_ROWS, BANDS = 5, 14
_MIXES = np.array([xxhash.xxh64_intdigest(k.to_bytes(4, "little"), SEED) | 1 for k in range(2 * BAND_ROWS * BANDS)], np.uint64)


def position_bytes(shingles: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a set of hashes: BAND_ROWS * BANDS bytes; all 255 for an empty set."""
    out, (flip, times) = np.full(BAND_ROWS * BANDS, 2**64 - 1, np.uint64), _MIXES.reshape(2, -1)
    for k in range(0, len(shingles), 512):
        x = (shingles[k : k + 512, None] ^ flip) * times
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        out = np.minimum(out, x.min(0))
    return out.astype(np.uint8)


def runs(positions: np.ndarray) -> list[int]:
    """One key for each run of positions: its number and its bytes, as a long."""
    rows = np.zeros((BANDS, 8), np.uint8)
    rows[:, :BAND_ROWS], rows[:, BAND_ROWS] = positions.reshape(BANDS, BAND_ROWS), np.arange(BANDS)
    return rows.view("<i8").ravel().tolist()


def set_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard's similarity of two shingle sets; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id_col, fp): the SimHash of each row's whole text, as a signed long.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of `shingle` words are joined by one
    space and hashed with XXH64 (seed 42); a bit is 1 if set in over half the shingles. A text with fewer words
    is one shingle; null and wordless texts have fingerprint zero. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), run, "doc_id long, fp long").withColumnRenamed("doc_id", id_col)


def _forest(fps: np.ndarray, block: np.ndarray, i: int, j: int, min_shared: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links in one group: all its pairs if i == j, else those between the blocks."""
    n = len(fps)
    if n == 2:  # most lists
        x = np.array([fps[0] ^ fps[1]])
        ok = block[0] != block[1] or i == j
        ok = ok and int((x.view(np.uint8) == 0).sum()) >= min_shared and int(np.bitwise_count(x)[0]) <= max_bits
        return (fps[:1], fps[1:]) if ok else (fps[:0], fps[:0])
    linked = np.zeros((n, n), bool)
    for k in range(0, n, 64):
        x = fps[k : k + 64, None] ^ fps[None, :]
        shared = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), n, NBYTES) == 0).sum(-1)
        a, b = np.nonzero(shared >= min_shared)
        good = np.bitwise_count(x[a, b]) <= max_bits
        if i != j:
            good &= block[a + k] != block[b]
        linked[a[good] + k, b[good]] = True
    a, b = _spanning(linked)
    return fps[a], fps[b]


def _spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of chains through the components of a symmetric matrix of links."""
    n = len(linked)
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(1)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    return order[:-1][same], order[1:][same]


def _byte(p: int):
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))


def _by_triple(fps: DataFrame) -> DataFrame:
    """(key, used, fp): the postings of the 20 triples; `used` has a bit for each position in the key."""
    keys = [F.struct(F.shiftleft(F.lit(k).cast("long"), 24).bitwiseOR(F.shiftleft(_byte(x), 16)).bitwiseOR(F.shiftleft(_byte(y), 8)).bitwiseOR(_byte(z)).alias("key"), F.lit(1 << x | 1 << y | 1 << z).alias("used")) for k, (x, y, z) in enumerate(covering_triples())]
    return fps.select("fp", F.explode(F.array(*keys)).alias("x")).select("x.key", "x.used", "fp")


def _by_fourth(hot: DataFrame) -> DataFrame:
    """Pairs share four bytes at least, so those of a triple's list meet again under one of its five other bytes."""
    mask = [F.when(F.col("used").bitwiseAND(F.lit(1 << p)) != 0, F.lit((255 << 8 * p) - (1 << 64 if p == 7 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for p in range(NBYTES)]
    more = hot.select("fp", "used", F.explode(F.array(*map(F.lit, range(NBYTES)))).alias("p"))
    more = more.where(F.expr("used & shiftleft(1, p) = 0")).select("fp", F.expr("used | shiftleft(1, p)").alias("used"))
    masked = F.col("fp").bitwiseAND(F.aggregate(F.array(*mask), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x)))
    return more.select(F.xxhash64("used", masked).alias("key"), "used", "fp").distinct()


def _by_halves(hot: DataFrame) -> DataFrame:
    """Under four equal bytes, the eight half bytes of the others differ in four places at most: triples of those."""
    at = F.filter(F.array(*map(F.lit, range(NBYTES))), lambda p: F.expr("used").bitwiseAND(F.call_function("shiftleft", F.lit(1), p)) == 0)
    rest = F.aggregate(at, F.lit(0).cast("long"), lambda a, p: F.shiftleft(a, 8).bitwiseOR(F.call_function("shiftrightunsigned", F.col("fp"), 8 * p).bitwiseAND(F.lit(255).cast("long"))))
    half = [F.shiftright("_rest", 4 * p).bitwiseAND(F.lit(15).cast("long")) for p in range(NBYTES)]
    keys = F.array(*(F.xxhash64("key", F.lit(k), half[x], half[y], half[z]) for k, (x, y, z) in enumerate(covering_triples())))
    return hot.withColumn("_rest", rest).select(F.explode(keys).alias("key"), "used", "fp")


#: Fingerprints in a list from which it is keyed anew instead of compared.
HOT_ROWS = 1024


def links(fps: DataFrame, *, max_bits: int = 4, list_rows: int = 256, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(a, b): edges that connect the distinct fingerprints `fps` (a table with column fp) exactly as all pairs of
    at most `max_bits` (4 at most) differing bits do.

    Lists over `hot_rows` are keyed anew by a fourth byte, those still over it by half bytes; what then remains shares 44
    of 64 bits, so it is bounded, and is compared in blocks.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("the index guarantees recall for 0 to 4 differing bits")
    min_shared, found, postings = NBYTES - max_bits, [], _by_triple(fps)
    for again in (_by_fourth, _by_halves, None):
        lists = materialize(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "lists")
        met = postings.join(lists, "key")
        if again is None:
            found.append(met)
            break
        found.append(met.where(F.col("n") <= hot_rows))
        hot = materialize(met.where(F.col("n") > hot_rows), "hot")
        if hot.isEmpty():
            break
        postings = again(hot)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / list_rows).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            key, i, j = cols[:3]
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if not len(cuts):
                rest = cols
                continue
            yield from groups([c[: cuts[-1]] for c in cols], cuts[:-1])
            rest = [c[cuts[-1] :] for c in cols]
        if rest is not None and len(rest[0]):
            yield from groups(rest, np.array([], np.int64))

    def groups(cols: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _, i, j, block, fp = cols
        fp, found = fp.view(np.uint64), []
        bounds = [0, *cuts.tolist(), len(fp)]
        for s, e in zip(bounds, bounds[1:], strict=False):
            if e - s > 1:
                found.append(_forest(fp[s:e], block[s:e], int(i[s]), int(j[s]), min_shared, max_bits))
        if found:
            a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return map_arrow(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "a long, b long")


def _cells(rows: DataFrame, *cols: str) -> DataFrame:
    """Rows of lists that have `blocks`, dealt to the pairs of blocks that they take part in, sorted by list and pair."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", *cols)
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _in_cells(rows: DataFrame, edges) -> DataFrame:
    """(a, b): what `edges(cell, between)` gives for each cell of _cells(); only links of two blocks are wanted if `between`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            key, i, j = (b.column(c).to_numpy() for c in range(3))
            if not len(key):
                continue
            cuts = (np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(b)], strict=True):
                if rest and any(rest[0].column(c)[0].as_py() != x for c, x in enumerate((key[s], i[s], j[s]))):
                    yield from cell(rest)
                    rest = []
                rest.append(b.slice(s, e - s))
        if rest:
            yield from cell(rest)

    def cell(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = pa.concat_batches(parts) if len(parts) > 1 else parts[0]
        if len(b) > 1:
            x, y = edges(b, b.column(1)[0].as_py() != b.column(2)[0].as_py())
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return map_arrow(rows, run, "a long, b long")


#: Jaccard similarity of five-word shingle sets from which two texts are near-duplicates.
SIMILAR = 0.8
#: By how much the share of equal positional bytes may fall short of the similarity before a pair is not looked at: over
#: four standard deviations at 0.8.
SLACK = 0.2


def candidate_links(nodes: DataFrame, *, similarity: float = SIMILAR, list_rows: int = 256) -> DataFrame:
    """(a, b): edges of spanning forests of the candidate pairs of `nodes` (node long, bytes binary, runs array of longs).

    Candidates share a run of bytes, and no smaller share of all positional bytes than `similarity` less SLACK: the tally
    of a pair. Only ids go through the index; the bytes join the rows of lists that hold more than one.
    """
    least = (similarity - SLACK) * BAND_ROWS * BANDS
    postings = nodes.select("node", F.explode("runs").alias("key"))
    lists = materialize(postings.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / list_rows).cast("int").alias("blocks")), "wide_lists")
    found = materialize(postings.join(lists, "key"), "wide_postings")

    def edges(b: pa.RecordBatch, between: bool) -> tuple[np.ndarray, np.ndarray]:
        block, node = b.column(3).to_numpy(), b.column(4).to_numpy()
        held = np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(len(b), -1)
        linked = np.zeros((len(b), len(b)), bool)
        for k in range(0, len(b), 32):
            linked[k : k + 32] = (held[k : k + 32, None, :] == held[None, :, :]).sum(-1, dtype=np.uint8) >= least
        if between:
            linked &= block[:, None] != block[None, :]
        x, y = _spanning(linked)
        return node[x], node[y]

    return _in_cells(_cells(found.join(nodes.select("node", "bytes"), "node"), "bytes"), edges)


def similar_links(texts: DataFrame, *, shingle: int, similarity: float = SIMILAR) -> DataFrame:
    """(a, b): edges that connect nodes exactly as all pairs of one list whose shingle sets are `similarity` alike do.

    `texts` has key, blocks, node, bytes and text. Every pair of a list is compared by its whole sets but those already
    connected, those whose sizes rule it out, and those that SLACK does. Texts whose set is not the node's are
    passed over (rows that share an id with the node's own).
    """
    least = (similarity - SLACK) * BAND_ROWS * BANDS

    def edges(b: pa.RecordBatch, between: bool) -> tuple[list[int], list[int]]:
        named: dict[int, tuple[int, np.ndarray]] = {}
        for k, (node, text) in enumerate(zip(b.column(4).to_pylist(), b.column(6).to_pylist(), strict=True)):
            if node not in named and set_name(x := shingle_set(text, shingle)) == node:
                named[node] = k, x
        at = [k for k, _ in named.values()]
        nodes, sets = list(named), [x for _, x in named.values()]
        if len(nodes) < 2:
            return [], []
        block, sizes, label = b.column(3).to_numpy()[at], np.array([len(x) for x in sets]), np.arange(len(nodes))
        all_ = b.column(5).to_pylist()
        held = np.frombuffer(b"".join(all_[k] for k in at), np.uint8).reshape(len(nodes), -1)
        left, right = [], []
        for k in range(len(nodes) - 1):
            ok = (held[k + 1 :] == held[k]).sum(1) >= least
            ok &= np.minimum(sizes[k + 1 :], sizes[k]) >= similarity * np.maximum(sizes[k + 1 :], sizes[k])
            if between:
                ok &= block[k + 1 :] != block[k]
            for m in (np.flatnonzero(ok) + k + 1).tolist():
                if label[m] != label[k] and set_similarity(sets[k], sets[m]) >= similarity:
                    left.append(nodes[k])
                    right.append(nodes[m])
                    label[label == label[m]] = label[k]
        return left, right

    return _in_cells(_cells(texts, "bytes", "text"), edges)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4, list_rows: int = 256) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of `docs`, repeated rows included.

    component_id is the smallest id that can be reached over links of at most `max_bits` differing bits, the
    row's own included. Equal fingerprints are one node, so copies cost nothing beyond their own row. Rows with
    a null id take part; their component is the smallest id that is not null, or null if there is none. An empty
    table gives an empty table. Columns other than the two named are not read.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).withColumnRenamed(id_col, "doc_id"), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    labels = materialize(connected_components(links(nodes, max_bits=max_bits, list_rows=list_rows)), "labels")
    least = materialize(labels.join(nodes, labels["node"] == nodes["fp"]).groupBy("label").agg(F.min("rep").alias("least")), "least")
    named = materialize(nodes.join(labels.join(least, "label"), nodes["fp"] == F.col("node"), "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "named")
    out = prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    return out.withColumnRenamed("doc_id", id_col)


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (id, node) of every row with an id, and of every node the smallest (rep, node) of its component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scratch("fingerprints")
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b.column(1).to_pylist()]
            wide = [position_bytes(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(set_name, sets)), pa.int64()), pa.array([w.tobytes() for w in wide], pa.binary()), pa.array(list(map(runs, wide)), pa.list_(pa.int64()))], ["id", "node", "bytes", "runs"])

    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    prints = materialize(map_arrow(named, run, "id long, node long, bytes binary, runs array<long>"), "wide")
    # rows of one set are one node, so hot groups of copies stay out of the index
    nodes = materialize(prints.groupBy("node").agg(F.min("id").alias("rep"), F.min("bytes").alias("bytes"), F.min("runs").alias("runs")), "wide_nodes")
    near = materialize(connected_components(candidate_links(nodes, similarity=similarity, list_rows=list_rows)), "wide_near")
    lists = near.groupBy("label").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("blocks"))
    members = materialize(near.join(lists, "label").join(nodes, "node").select(F.col("label").alias("key"), "blocks", "node", "bytes", "rep"), "wide_members")
    texts = materialize(named.join(members, named["id"] == members["rep"]).select("key", "blocks", "node", "bytes", "text"), "wide_texts")
    labels = materialize(connected_components(similar_links(texts, shingle=shingle, similarity=similarity)), "wide_labels")
    least = materialize(labels.join(nodes, "node").groupBy("label").agg(F.min(F.struct("rep", "node")).alias("least")), "wide_least")
    linked = materialize(labels.join(least, "label").select("node", "least"), "wide_components")
    heads = nodes.join(linked, "node", "left").select("node", F.coalesce("least", F.struct("rep", "node")).alias("head"))
    return prints.select("id", "node"), materialize(heads, "wide_heads")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILAR, list_rows: int = 256) -> DataFrame:
    """(id_col, component_id) of every row with an id: components of texts whose shingle sets have a Jaccard similarity
    of `similarity` at least. component_id is the smallest id reachable.

    SimHash tells such a similarity too coarsely, at 512 bits still by a standard deviation of 0.02 and more. So the
    inverted index of byte positions, the tally and the verification stand on bytes that agree as often as the sets do,
    and pairs are linked by their sets of shingles alone.
    """
    prints, heads = _similar(docs, id_col, text_col, shingle, similarity, list_rows)
    return prints.join(heads, "node").select(F.col("id").alias(id_col), F.col("head.rep").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILAR) -> DataFrame:
    """The rows of `docs`, whole, that stand for their component: of each one row, of those with its smallest id.

    Rows repeated under one id leave one row for each component among them. Rows with a null id stay: nothing names them.
    """
    prints, heads = _similar(docs, id_col, text_col, shingle, similarity, 256)
    kept, of, repeated, node = spare(docs, "kept", "of", "many", "node")
    chosen = heads.where("head.node = node").select(F.col("head.rep").alias(kept), F.col("node").alias(of))
    many = materialize(prints.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(repeated)), "repeated")
    alone = materialize(chosen.join(many, chosen[kept] == many[repeated], "left_anti").select(kept), "kept")
    # one plan at every size: a join on ids that occur once
    out = docs.join(alone.hint("merge"), docs[id_col] == alone[kept], "left_semi").unionByName(docs.where(F.col(id_col).isNull()))
    if many.isEmpty():
        return out
    again = docs.join(many, docs[id_col] == many[repeated], "left_semi")
    fields, at = StructType([*docs.schema, StructField(node, LongType())]), docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [set_name(shingle_set(t, shingle)) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.int64())], fields.names)

    rows = map_arrow(again, named, fields)
    rows = rows.join(chosen, (rows[id_col] == chosen[kept]) & (rows[node] == chosen[of]), "left_semi")
    return out.unionByName(rows.dropDuplicates([id_col, node]).drop(node))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
