"""Byte-level BPE encoding and decoding with one global shuffle of distinct words.

Texts are cut into pre-tokens ("words", a leading space included). Each input partition groups its documents into
blocks; a block keeps every document as the positions' word numbers and one row per distinct word. The word rows
are shuffled by word, each distinct word of the corpus is encoded once, its ids join all its rows, and these
return to their blocks, where documents are put together by position. Decoding joins ids with the token-byte
table, whose size is the vocabulary's.

Texts themselves are never shuffled, and the most frequent word has one row a block.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..cluster import map_arrow
from .common import Numbers, table, text_or_empty

#: Unicode's White_Space, as the pattern's engine understands \s.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
BLOCK_CHARS = 1 << 25
OUT_BYTES = 1 << 25
MARKS = frozenset(".,!?;:")


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def word_encoder(path: str):
    """A function from the bytes of one pre-token to its ids, by the merges alone."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={})._encode_single_piece


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes end to end, and where each id starts (one more entry than ids)."""
    ranks = load_ranks(path)
    by_id = [b""] * (max(ranks.values()) + 1)
    for k, v in ranks.items():
        by_id[v] = k
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in by_id])])


#: The pattern for which texts are taken apart at single spaces and runs of letters need no pattern. Fixed value.
COMMON_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """A function from a text to its pre-tokens; white space means what the library's engine takes for it."""
    import regex

    out, inside, k = [], False, 0
    while k < len(pattern):
        two = pattern[k : k + 2]
        if two == r"\s":
            out.append(SPACE if inside else f"[{SPACE}]")
        elif two == r"\S":
            if inside:
                raise ValueError(r"\S inside a character class is not supported")
            out.append(f"[^{SPACE}]")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out.append(two[0])
        k += 2 if two[0] == "\\" else 1
    compiled = regex.compile("".join(out))
    return lambda text: [m[0] for m in compiled.finditer(text)] if compiled.groups else compiled.findall(text)


@lru_cache(maxsize=1)
def _odd_spaces():
    import regex

    return regex.compile(rf"(?:\A|[{SPACE}]) | \Z").search


def _keys(text: str, findall, odd) -> list:
    """What a text is made of: strings stand between two single spaces (the first of them belongs to it), a tuple
    holds one pre-token as it is. Patterns other than the common one (no `odd`) give pre-tokens alone."""
    if odd is None or odd(text):
        return [(t,) for t in findall(text)]
    head, *tail = text.split(" ")
    return [*((t,) for t in findall(head)), *tail]


def _words(keys: Numbers, findall) -> tuple[Numbers, np.ndarray, np.ndarray]:
    """The pre-tokens of all keys, numbered by first use; and of each key, in order, how many it has and their numbers."""
    numbers, size, flat = Numbers(), np.ones(len(keys), np.int64), []
    number, put = numbers.__getitem__, flat.append
    for k, key in enumerate(keys):
        if type(key) is tuple:
            put(number(key[0]))
        elif key.isascii() and key.isalpha():  # what the pattern makes of letters, and of letters and one mark
            put(number(" " + key))
        elif key.isascii() and key[-1] in MARKS and key[:-1].isalpha():
            put(number(" " + key[:-1]))
            put(number(key[-1]))
            size[k] = 2
        else:
            found = findall(" " + key)
            flat.extend(map(number, found))
            size[k] = len(found)
    return numbers, size, np.array(flat, np.int64)


def pack_ints(v: np.ndarray) -> bytes:
    """7 bits a byte, low bits first, the high bit set on all bytes of a number but its last."""
    v = v.astype(np.uint64)
    size = 1 + sum((v >= (1 << (7 * k))).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(5):
        some = size > k
        if not some.any():
            break
        at = ends[some] - size[some] + k
        out[at] = ((v[some] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpack_ints(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    out = (b[first] & 127).astype(np.int64)
    for k in range(1, 5):
        more = first + k <= last
        if not more.any():
            break
        out[more] |= (b[first[more] + k] & 127).astype(np.int64) << (7 * k)
    return out


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[starts[w]:starts[w + 1]] for each w in `which`, end to end."""
    size = starts[which + 1] - starts[which]
    ends = np.cumsum(size)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts[which] - (ends - size), size) + np.arange(ends[-1])]


WORD_ROW = "word string, at long"
PACK_ROW = "block long, kind int, n long, one binary, two binary"
_PACK = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("n", pa.int64()), ("one", pa.binary()), ("two", pa.binary())])
#: Word numbers within a block take the low bits of `at`, its block the high ones: partition, then block of the partition.
NUMBER_BITS = 26
BLOCK_BITS = 14
NUMBERS = (1 << NUMBER_BITS) - 1
ROW_KEYS = 1 << 17


def _pack(block: int, kind: int, n: int, one: bytes, two: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, kind, n, one, two), _PACK, strict=True)], schema=_PACK)


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, block_chars: int, place: bool) -> Iterator[tuple[int, list, list[np.ndarray], Numbers]]:
    """(block, ids, with `place` the key numbers of each text, the block's keys), block by block."""
    findall, odd = splitter(pattern), _odd_spaces() if pattern == COMMON_PATTERN else None
    block, chars, keys, ids, seqs = None, 0, Numbers(), [], []
    number = keys.__getitem__
    for b in batches:
        if block is None and len(b):
            block = first = b.column(2)[0].as_py() << BLOCK_BITS
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = _keys(text, findall, odd)
            if place:
                ids.append(doc)
                seqs.append(np.fromiter(map(number, found), np.int32, len(found)))
            else:
                for key in dict.fromkeys(found):
                    number(key)
            chars += len(text)
            if chars >= block_chars:
                yield block, ids, seqs, keys
                if block + 1 == first + (1 << BLOCK_BITS):
                    raise ValueError(f"over {1 << BLOCK_BITS} blocks of {block_chars} characters in a partition")
                block, chars, keys, ids, seqs = block + 1, 0, Numbers(), [], []
                number = keys.__getitem__
    if block is not None:
        yield block, ids, seqs, keys


def checksum(numbered) -> int:
    out, h = 0, xxhash.xxh3_64_intdigest
    for n, word in numbered:
        out ^= h(word, n)
    return out


def distinct_words(docs: DataFrame, pattern: str, block_chars: int) -> DataFrame:
    """(word, at): each block's distinct words, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _, keys in _blocks(batches, pattern, block_chars, False):
            names = list(_words(keys, splitter(pattern))[0])
            if len(names) > NUMBERS:
                raise ValueError(f"over {NUMBERS} distinct words in a block")
            for k in range(0, len(names), 50_000):
                part = names[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(np.arange(k, k + len(part)) + (block << NUMBER_BITS))], ["word", "at"])

    return map_arrow(docs, run, WORD_ROW)


def positions(docs: DataFrame, pattern: str, block_chars: int) -> DataFrame:
    """Rows of kind 1: documents of a block, `one` their ids and lengths, `two` their word numbers by position.

    A row of kind 2 has the number of the block's words and the XOR of the hashes of (number, word).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for block, ids, seqs, keys in _blocks(batches, pattern, block_chars, True):
            numbers, size, flat = _words(keys, splitter(pattern))
            starts = np.concatenate([[0], np.cumsum(size)])
            yield _pack(block, 2, 0, len(numbers).to_bytes(8, "little"), checksum(enumerate(numbers)).to_bytes(8, "little"))
            first = held = 0
            for k, seq in enumerate(seqs):
                held += len(seq)
                if held >= ROW_KEYS or k == len(seqs) - 1:
                    at = [gather(flat, starts, s) for s in seqs[first : k + 1]]
                    head = np.array([(i or 0, i is None, len(x)) for i, x in zip(ids[first : k + 1], at, strict=True)], np.int64).T
                    yield _pack(block, 1, first, head.tobytes(), squeeze(pack_ints(np.concatenate(at))))
                    first, held = k + 1, 0

    return map_arrow(docs, run, PACK_ROW)


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Rows of kind 0: some words of a block, `one` a checksum and their numbers, `two` the lengths of their ids and the ids.

    `words` lie sorted by word, so that all rows of a word are together and it is encoded once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids, n, h = word_encoder(path), None, [], 0, xxhash.xxh3_64_intdigest
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> Iterator[pa.RecordBatch]:
            at, size, flat, sums = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.concatenate([[0], np.cumsum(size)])
            order = np.argsort(at, kind="stable")
            blocks = at[order] >> NUMBER_BITS
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(order)]
            for s, e in zip(cuts, cuts[1:], strict=False):
                some = order[s:e]
                yield _pack(int(blocks[s]), 0, n, np.bitwise_xor.reduce(sums[some]).tobytes() + pack_ints(np.diff(at[some] & NUMBERS, prepend=0)), pack_ints(np.concatenate([size[some], gather(flat, starts, some)])))

        rows = 0
        for b in batches:
            sizes, flat, sums = [], [], []
            for w, k in zip(b.column(0).to_pylist(), (b.column(1).to_numpy() & NUMBERS).tolist(), strict=True):
                if w != last:
                    last, ids = w, encode(w)
                sizes.append(len(ids))
                flat.extend(ids)
                sums.append(h(w, k))
            held.append((b.column(1).to_numpy(), np.array(sizes, np.int64), np.array(flat, np.int64), np.array(sums, np.uint64)))
            rows += len(b)
            if rows >= 1 << 20:
                yield from out()
                held, rows, n = [], 0, n + 1
        if held:
            yield from out()

    return map_arrow(words, run, PACK_ROW)


def partitions_for(docs: DataFrame, bytes_each: int = 1 << 27) -> tuple[int, ...]:
    """How many partitions to ask of repartition(): none where the session's number will do (adaptive execution then joins
    small ones), else one for each `bytes_each` that the optimizer expects of `docs`, since nothing splits them later."""
    n = -(-int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // bytes_each)
    return (min(n, 1 << 20),) if n > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()


def encode(docs: DataFrame, *, path: str, pattern: str = COMMON_PATTERN, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col long, ids binary): each row's ids as little-endian unsigned 32-bit integers.

    As tiktoken's encode_ordinary with the ranks at `path` and `pattern` would give; null and empty texts have no
    ids. Rows with null or repeated ids each keep their own row. Other columns are not read. `docs` is read twice
    and has to give the same rows in the same partitions both times, as a stored table does; each block's checksum
    is compared, and a difference is an error, never a wrong result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), F.spark_partition_id().alias("part"))
    parts = partitions_for(docs)
    words = encode_words(distinct_words(source, pattern, block_chars).repartition(*parts, "word").sortWithinPartitions("word"), path)
    both = words.unionByName(positions(source, pattern, block_chars)).repartition(*parts, "block").sortWithinPartitions("block", F.expr("CASE kind WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END"), "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        block, parts, values, starts, total = None, [], None, None, 0
        for b in batches:
            for row in b.to_pylist():
                if row["block"] != block:
                    block, parts, values, total = row["block"], [], None, 0
                if row["kind"] == 0:
                    total ^= int.from_bytes(row["one"][:8], "little")
                    at, data = np.cumsum(unpack_ints(row["one"][8:])), unpack_ints(row["two"])
                    parts.append((at, data[: len(at)], data[len(at) :].astype("<u4")))
                elif row["kind"] == 2:
                    count = int.from_bytes(row["one"], "little")
                    at, size, flat = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
                    if len(at) != count or total != int.from_bytes(row["two"], "little"):
                        raise RuntimeError("the documents changed between the two readings")
                    order = np.argsort(at)
                    values = gather(flat.astype("<u4"), np.concatenate([[0], np.cumsum(size)]), order)
                    starts, parts = np.concatenate([[0], np.cumsum(size[order])]), []
                else:
                    ids, null, size = np.frombuffer(row["one"], np.int64).reshape(3, -1)
                    seq = unpack_ints(expand(row["two"]))
                    docs, out, held, at = [], [], 0, 0
                    for doc, none, n in zip(ids.tolist(), null.tolist(), size.tolist(), strict=True):
                        docs.append(None if none else doc)
                        out.append(gather(values, starts, seq[at : at + n]).tobytes())
                        at, held = at + n, held + len(out[-1])
                        if held >= OUT_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])
                            docs, out, held = [], [], 0
                    if docs:
                        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "ids"])

    return map_arrow(both, run, "doc_id long, ids binary").withColumnRenamed("doc_id", id_col)


def decode(ids: DataFrame, *, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`ids` with the bytes of each row's ids in column `out`; null ids give null, an unknown id is an error."""
    fields = ids.schema
    with_out = StructType([*fields, StructField(out, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts = token_bytes(path)
        for b in batches:
            col = [None if x is None else gather(values, starts, np.frombuffer(x, "<u4").astype(np.int64)).tobytes() for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(col, pa.binary())], [*b.schema.names, out])

    at = fields.names.index(ids_col)
    return map_arrow(ids, run, with_out)


def digests(ids: DataFrame, *, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) of encode()'s rows, the decoded bytes made on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, starts = token_bytes(path)
        for b in batches:
            n, one, two = [], [], []
            for x in b.column(1).to_pylist():
                n.append(len(x) // 4)
                one.append(hashlib.sha256(x).hexdigest())
                two.append(hashlib.sha256(gather(values, starts, np.frombuffer(x, "<u4").astype(np.int64)).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(one), pa.array(two)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(ids, run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path=path, pattern=public_tokenizers.PATTERN), path=path)
