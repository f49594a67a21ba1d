"""Fill-in-middle transformation: texts cut at units and put together as prefix-suffix-middle or suffix-prefix-middle.

Units are runs of ASCII letters and single other characters. One Aho-Corasick automaton scans a text once for sparse
events: places where the class of characters changes, and sentinels, which forbid the transformation. Between two
events lies a run of one class, whose number of units is arithmetic (one for letters, its length for others), so that
sums over events are all that a rank lookup needs. Rows are transformed where they lie, without a shuffle.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..cluster import map_arrow
from .common import table, text_or_empty

#: Sentinels of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many are transformed, and how many of those begin with the suffix.
RATE, SPM_RATE = 90, 20
SEED = 1
OUT_BYTES = 1 << 24
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")


@lru_cache(maxsize=4)
def automaton(sentinels: tuple[str, ...]):
    """Pairs of ASCII characters of different class count 1, sentinels -1."""
    import ahocorasick

    if len(sentinels) != 3 or len(set(sentinels)) < 3 or not all(s.isascii() and len(s) > 2 for s in sentinels):
        raise ValueError("three different ASCII sentinels of three characters or more are needed")
    found, others = ahocorasick.Automaton(), [chr(c) for c in range(128) if chr(c) not in string.ascii_letters]
    for a in string.ascii_letters:
        for b in others:
            found.add_word(a + b, 1)
            found.add_word(b + a, 1)
    for s in sentinels:
        found.add_word(s, -1)
    found.make_automaton()
    return found


class Units:
    """Numbers of units at the ends of a text's runs, and the places of ranks."""

    def __init__(self, text: str, sentinels: tuple[str, ...] = SENTINELS):
        view = text if text.isascii() else text.encode("ascii", "replace").decode()  # one character for each; none becomes a letter
        events = np.fromiter((end * kind for end, kind in automaton(sentinels).iter(view)), np.int64)
        self.marked = bool((events < 0).any())
        self.starts = np.concatenate([[0], events[events > 0], [len(text)]]) if text else np.zeros(1, np.int64)
        sizes = np.diff(self.starts)
        self.letters = np.arange(len(sizes)) % 2 == (0 if view[:1].isalpha() else 1)
        self.ends = np.cumsum(np.where(self.letters, 1, sizes))
        self.n = int(self.ends[-1]) if len(sizes) else 0

    def place(self, rank: int) -> int:
        """Where the first `rank` units end."""
        if not rank:
            return 0
        run = int(np.searchsorted(self.ends, rank))
        return int(self.starts[run + 1] - (0 if self.letters[run] else self.ends[run] - rank))


def transformed(key: str, text: str, *, seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    units = Units(text, sentinels)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or units.marked or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    first, last = sorted((units.place(h1 % (units.n + 1)), units.place(h2 % (units.n + 1))))
    p, s, m = sentinels
    prefix, middle, suffix = text[:first], text[first:last], text[last:]
    if h4 % 100 < spm_rate:
        return units.n, "spm", first, last - first, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return units.n, "psm", first, last - first, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, sentinels: tuple[str, ...] = SENTINELS, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """`docs` with n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output.

    Row by row: repeated rows get the same output; a null text is empty and plain; a null id draws as an empty one; an
    empty table stays empty. A column of `docs` with one of the new names is an error. Cuts and forms depend on the
    id and the seed alone.
    """
    clash = set(NEW) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    options = {"seed": seed, "sentinels": tuple(sentinels), "rate": rate, "spm_rate": spm_rate}
    automaton(options["sentinels"])
    at, of = docs.columns.index(id_col), docs.columns.index(text_col)
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, size, start = [], 0, 0
            for row in range(batch.num_rows):
                key, text = batch.column(at)[row].as_py(), batch.column(of)[row].as_py() or ""
                done.append(transformed("" if key is None else str(key), text, **options))
                size += len(text)
                if size > OUT_BYTES or row == batch.num_rows - 1:
                    new = [pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(done)).columns, *new], names=[*batch.schema.names, *NEW])
                    start, done, size = row + 1, [], 0

    new = [StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", IntegerType()), StructField("middle_chars", IntegerType()), StructField("output", StringType())]
    return map_arrow(docs, run, StructType([*docs.schema.fields, *new]))


def restored(output: Column, form: Column, *, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that `output` was made of, from it and its form alone."""
    p, s, m = sentinels
    after = lambda mark: F.instr(output, mark) + len(mark)
    between = lambda a, b: F.substring(output, after(a), F.instr(output, b) - after(a))
    middle = F.substring(output, after(m), F.length(output))
    rest = F.when(form == "spm", F.concat(between(p, m), middle, between(s, p))).otherwise(F.concat(between(p, s), middle, between(s, m)))
    return F.when(form == "plain", output).otherwise(rest)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = fill_in_middle(docs)
    return rows.select("doc_id", "n", "form", F.col("prefix_chars").cast("long").alias("prefix_chars"), F.col("middle_chars").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_P, _S, _M = SENTINELS
OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), r AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, 8 * k + 1, 8) AS UBIGINT)) AS h FROM d
), c AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '{_P}') OR contains(t, '{_S}') OR contains(t, '{_M}') OR h[3] % 100 >= {RATE} THEN 'plain' WHEN h[4] % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM r
), x AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:CAST(a AS BIGINT)], '') AS p, array_to_string(u[CAST(a AS BIGINT) + 1:CAST(b AS BIGINT)], '') AS m, array_to_string(u[CAST(b AS BIGINT) + 1:], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{_P}' || p || '{_S}' || s || '{_M}' || m ELSE '{_S}' || s || '{_P}' || p || '{_M}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM x
"""
