"""Best-fit packing planned on the histogram of lengths.

The plan sees only how many pieces there are of each length (at most `capacity` counts). It lays out best-fit
decreasing on whole counts: bins that look alike are one group, and a length fills groups of bins in one step. The
plan comes out as runs ("pieces of length l with rank r0 to r1 lie k to a bin at this offset from bin b0 on"), and
each piece takes the slot that its rank within its length names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..cluster import map_arrow
from .common import Numbers, materialize, rank_in_group, scratch, spare, table, text_or_empty

CAPACITY = 4096
END_ID = 1
MEMO_WORDS = 700_000
#: Texts of about so many bytes are encoded at a time.
GROUP_BYTES = 1 << 22
#: ASCII marks that are one pre-token together; an apostrophe may begin one with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from texts to lists of ids, a flag for each id: whether it ends a pre-token, and the strings that the
    tokenizer takes for one id wherever they stand."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    many = getattr(t, "encode_batch_fast", t.encode_batch)
    ends = np.zeros(t.get_vocab_size(with_added_tokens=True), bool)
    suffix = getattr(t.model, "end_of_word_suffix", None)
    if suffix:
        for token, i in t.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith(suffix)
    added = tuple(x.content for x in t.get_added_tokens_decoder().values())
    return (lambda texts: [e.ids for e in many(texts, add_special_tokens=False)]), ends, added


class Vocabulary:
    """The ids of strings without white space, each learned once: `ids` end to end, where each string's start and how many.

    Runs of letters are one pre-token each, so many go through the tokenizer as one text whose ids are cut where
    pre-tokens end; marks behind such a run are a pre-token of their own. All others are encoded one by one.
    """

    def __init__(self, path: str):
        self.encode, self.ends, _ = _encoder(path)
        self.clear()

    def clear(self) -> None:
        self.words, self.ids, self.starts, self.sizes = Numbers(), np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of `words`, new ones learned."""
        first = len(self.words)
        out = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if len(self.words) > first:
            self._learn(first)
        return out

    def _since(self, first: int) -> list[str]:
        return list(islice(reversed(self.words), len(self.words) - first))[::-1]

    def _learn(self, first: int) -> None:
        number, letters, rest, marked = self.words.__getitem__, [], [], []
        whole = len(self.words)
        for n, w in enumerate(self._since(first), first):
            if w.isalpha():
                letters.append((n, w))
            elif (run := w.rstrip(MARKS)).isalpha() and (run.isascii() or normalize("NFC", run).lower().isalpha()):
                marked.append((n, number(run), number(w[len(run) :])))
            else:
                rest.append((n, w))
        for n, w in enumerate(self._since(whole), whole):
            (letters if w.isalpha() else rest).append((n, w))
        self.starts, self.sizes = (np.concatenate([x, np.zeros(len(self.words) - len(x), np.int64)]) for x in (self.starts, self.sizes))
        at, ids, sizes = [], [], []
        for k in range(0, len(letters), 4096):  # what the tokenizer returns is large
            groups = [letters[j : j + 256] for j in range(k, min(k + 4096, len(letters)), 256)]
            for group, found in zip(groups, self.encode([" ".join([w for _, w in g]) for g in groups]), strict=True):
                found = np.array(found, "<u4")
                cuts = np.flatnonzero(self.ends[found]) + 1
                if len(cuts) == len(group) and cuts[-1] == len(found):
                    at += [n for n, _ in group]
                    ids.append(found)
                    sizes.append(np.diff(cuts, prepend=0))
                else:
                    rest += group
        for k in range(0, len(rest), 4096):
            for (n, _), found in zip(rest[k : k + 4096], self.encode([w for _, w in rest[k : k + 4096]]), strict=True):
                at.append(n)
                ids.append(np.array(found, "<u4"))
                sizes.append([len(found)])
        self._put(np.array(at, np.int64), ids, sizes)
        if marked:
            n, run, mark = np.array(marked, np.int64).T
            self._put(n, [self.of(np.stack([run, mark], 1).ravel())], [self.sizes[run] + self.sizes[mark]])

    def _put(self, at: np.ndarray, ids: list, sizes: list) -> None:
        if len(at):
            self.sizes[at] = size = np.concatenate(sizes)
            self.starts[at] = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, *ids])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the strings with these numbers, end to end."""
        size = self.sizes[numbers]
        ends = np.cumsum(size)
        return self.ids[np.repeat(self.starts[numbers] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


#: White space that Arrow and the tokenizer do not both take for white space, or that few texts hold.
RARE_SPACE = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Beyond these characters the tokenizer's lower case, letter by letter after composition, may be another than Arrow's.
BEYOND = r"[^\x00-\x{12f}\x{131}-\x{17f}\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20ac}]"


def token_ids(texts: pa.Array, path: str) -> Iterator[memoryview]:
    """Ids (little-endian unsigned 32-bit) of whole texts, as the plain tokenizer gives them without special tokens.

    The tokenizer drops white space and never merges across it, so each distinct string between white space is
    encoded once and kept, as long as the memo has room. Texts with rarer white space, and those that hold the name of
    an added token (which is one id), are encoded whole. Case is folded first where that cannot change the ids.
    """
    encode, _, added = _encoder(path)
    memo = scratch(f"ids of {path}")
    if "words" not in memo:
        memo["words"] = Vocabulary(path)
    known, ends = memo["words"], np.cumsum(pc.binary_length(texts).to_numpy())
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, GROUP_BYTES + (ends[first - 1] if first else 0), "right")))
        some = texts.slice(first, last - first)
        whole = pc.match_substring_regex(some, RARE_SPACE)
        for name in added:
            whole = pc.or_(whole, pc.match_substring(some, name))
        split = pc.if_else(pc.match_substring_regex(some, BEYOND), some, pc.utf8_lower(some))
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", split))
        words = split.flatten().dictionary_encode()
        if len(known.words) > MEMO_WORDS:
            known.clear()
        names = words.dictionary.to_pylist()
        numbers = known.numbers(names)[words.indices.to_numpy()]
        cuts = split.offsets.to_numpy() - split.offsets[0].as_py()
        sums = (4 * np.concatenate([[0], np.cumsum(known.sizes[numbers])])[cuts]).tolist()
        data = memoryview(known.of(numbers)).cast("B")
        for k, alone in enumerate(whole.to_pylist()):
            yield memoryview(np.array(encode([some[k].as_py()])[0], "<u4").tobytes()) if alone else data[sums[k] : sums[k + 1]]
        first = last


def pieces(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every row's ids (then `end_id`), cut into pieces of `capacity` where there are more.

    (doc_id, piece, start, length, ids_crc32), and with keep_ids the piece's ids as little-endian unsigned 32-bit
    integers. Null text counts as empty, which is one piece of one id. Ids may be null or repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1)
            found = zip(names, token_ids(texts, path), strict=True)
            for _ in range(0, len(names), 256):
                cols: list[list] = [[], [], [], [], [], []]
                for name, ids in islice(found, 256):
                    ids = bytes(ids) + tail
                    for i, at in enumerate(range(0, max(len(ids), 1), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for col, v in zip(cols, (name, i, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None), strict=True):
                            col.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[: 5 + keep_ids], kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_arrow(source, run, PIECE + (", ids binary" if keep_ids else "")).withColumnRenamed("doc_id", id_col)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, ranks, first bin, pieces a bin, offset).

    Longest first; each length goes into the fullest bins that still take it, as many to a bin as fit, and into new
    bins last. Bins that look alike are ranges kept by the room that they have left.
    """
    rooms: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = {}
    runs, bins = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                ranges[room] = []
                insort(rooms, room)
            ranges[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit {capacity}")
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = min(capacity // length, left)
                first, n, room = bins, max(1, left // each), capacity
                bins += n
            else:
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room], rooms[at]
                each = min(room // length, left)
                take = min(n, left // each)
                put(room, first + take, n - take)
                n = take
            runs.append((length, rank, n * each, first, each, capacity - room))
            put(room - each * length, first, n)
            rank, left = rank + n * each, left - n * each
    return runs


def assign(parts: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY, seed: int = 0) -> DataFrame:
    """`parts` with sequence_id and offset: as few sequences of at most `capacity` as best fit makes.

    Lengths are from 1 to `capacity`; columns of `parts` must not be named sequence_id or offset, any others stay as
    they are. Runs of the plan number in the tens of thousands at most, whatever the number of rows: each one uses up a
    length or a range of bins.
    """
    clash = {"sequence_id", "offset"} & {c.lower() for c in parts.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    row, key, rank_ = spare(parts, "row", "key", "rank")
    rest, fields = parts.columns, StructType([*parts.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    parts = materialize(parts.withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in parts.groupBy(length_col).agg(F.count("*")).collect()}  # at most `capacity` rows
    runs = plan(counts, capacity)
    whole = np.array(runs, np.int64).reshape(-1, 6)
    whole = whole[np.lexsort((whole[:, 1], whole[:, 0]))]
    names, first = np.unique(whole[:, 0], return_index=True)
    by_length = {int(n): r[:, 1:] for n, r in zip(names, np.split(whole, first[1:]), strict=True)} if len(runs) else {}
    sent = parts.sparkSession.sparkContext.broadcast(by_length)
    keyed = parts.withColumn(key, F.xxhash64(F.lit(seed), row))
    ranked = rank_in_group(keyed, [length_col], key, row, rank_).drop(key, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_of = sent.value
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(len(b.schema) - 1).to_numpy()
            seq, off = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                r = runs_of[int(n)]
                k = np.searchsorted(r[:, 0], rank[mine], "right") - 1
                inside = rank[mine] - r[k, 0]
                seq[mine], off[mine] = r[k, 2] + inside // r[k, 3], r[k, 4] + inside % r[k, 3] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], fields.names)

    at = rest.index(length_col)
    return map_arrow(ranked, run, fields)


def pack(docs: DataFrame, *, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int | None = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece of each row of `docs`: pieces() with its sequence_id and offset, gapless from 0."""
    return assign(pieces(docs, path=path, id_col=id_col, text_col=text_col, capacity=capacity, end_id=end_id, keep_ids=keep_ids), capacity=capacity)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), path=public_tokenizers.path("word_bpe_49k.json"))
