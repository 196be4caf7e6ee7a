"""Fill-in-middle transformation over words of eight bytes.

The UTF-8 bytes of a batch are viewed as uint64.  Blanks and characters are told
in all eight bytes of a word at once by arithmetic, a set high bit marking a
byte; counts of marks per word, summed up, lead from a unit's number to the word
it ends in, and byte-wise prefix sums inside the word to the byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx

SLICE = 4 << 20
MARKS = ("<P>", "<S>", "<M>")
MADE = ("n", "form", "prefix_chars", "middle_chars", "output")

_U = np.uint64
_ONES = _U(0x0101010101010101)
_HIGH = _U(0x8080808080808080)
_LOW = ~_HIGH


def _all(byte: int) -> np.uint64:
    return _ONES * _U(byte)


def blanks(x: np.ndarray) -> np.ndarray:
    """High bits at the bytes 0x20 and 0x09 to 0x0D; no sum of two bytes carries, as both have their high bit clear."""
    low = x & _LOW
    not_space = (low ^ _all(0x20)) + _LOW
    control = (low + _all(0x80 - 0x09)) & ~(low + _all(0x80 - 0x0E))
    return (~not_space | control) & ~x & _HIGH


class Bits:
    """Rank and select over marked bytes."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.zeros(len(marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each byte offset; the marks end with a word without any."""
        word, inner = at >> 3, (at & 7).astype(np.uint64) << _U(3)
        return self.before[word] + np.bitwise_count(self.marks[word] & ((_U(1) << inner) - _U(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """Byte offset of each k-th mark, from 0."""
        word = np.searchsorted(self.before, k, "right") - 1
        inside = (k - self.before[word]).astype(np.uint64)
        sums = (self.marks[word] >> _U(7)) * _ONES  # in each byte the marks up to it
        return word * 8 + np.bitwise_count(((inside * _ONES) | _HIGH) - sums & _HIGH)


class Units:
    """Ends of units and first bytes of characters of a run of texts."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        self.at = at
        whole = np.zeros((len(raw) >> 3) + 2, "<u8")
        whole.view(np.uint8)[: len(raw)] = raw
        padding = whole.view(np.uint8)[len(raw) :]
        padding[:] = 0x20
        solid = ~blanks(whole) & _HIGH
        following = solid >> _U(8)
        following[:-1] |= solid[1:] << _U(56)
        ends = solid & ~following
        last = at[1:][at[1:] > at[:-1]] - 1
        np.bitwise_or.at(ends, last >> 3, _U(0x80) << ((last & 7).astype(np.uint64) << _U(3)))
        padding[:] = 0x80
        self.ends = Bits(ends)
        self.chars = Bits(~(whole & ~(whole << _U(1))) & _HIGH)
        self.first = self.ends.rank(at)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def cut(self, units: np.ndarray) -> np.ndarray:
        """Where so many units of each text end."""
        out = self.at[:-1].copy()
        some = units > 0
        out[some] = self.ends.select(self.first[:-1][some] + units[some] - 1) + 1
        return out


def transformed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 42, fim_share: int = 50, spm_share: int = 80) -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` to each row.

    A unit is a word with the blanks before it, or the blanks at the end.  Cuts
    and form come from the SHA-256 of ``seed:doc_id``, so reruns agree.  ``form``
    is ``plain`` for texts that are empty or hold a mark of ``MARKS``, and for all
    but ``fim_share`` of a hundred of the others; ``spm`` for ``spm_share`` of a
    hundred of the rest, else ``psm``.  One pass without a shuffle; a slice of
    texts has 4 MB, a longer text stands alone and costs by its length.

    A null text counts as an empty one: plain, no units, empty output.  A null id
    is hashed as an empty string.  Repeated rows are transformed alike, an empty
    table gives no rows, extra columns ride along, and those with these names
    are replaced.
    """
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    source = docs.select(*[c for c in docs.columns if c not in MADE])
    hashes = F.array(*[F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])
    made = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}
    schema = source.withColumns({c: F.lit(None).cast(t) for c, t in made.items()}).schema
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, text, SLICE):
            h = b.column(b.num_columns - 1).flatten().to_numpy().reshape(-1, 4)
            n, form, prefix, middle, output = apart(b.column(at), h, fim_share, spm_share)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n, form, prefix, middle, output], names=schema.fieldNames())

    return source.withColumn("form", hashes).mapInArrow(run, schema)


def apart(texts: pa.Array, h: np.ndarray, fim_share: int, spm_share: int) -> tuple[pa.Array, ...]:
    """(n, form, prefix_chars, middle_chars, output) of a batch, given four hashes a text."""
    words = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(words.type)
    offsets = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1]
    at = offsets.astype(np.int64)
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at -= at[0]
    units = Units(raw, at)
    n = units.counts()
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    one, two = units.cut(ends[:, 0]), units.cut(ends[:, 1])
    marked = pc.or_(pc.or_(*[pc.match_substring(words, m) for m in MARKS[:2]]), pc.match_substring(words, MARKS[2]))
    plain = (at[1:] == at[:-1]) | marked.to_numpy(zero_copy_only=False) | (h[:, 2] % 100 >= fim_share)
    cuts = np.append(np.stack([at[:-1], one, two], axis=1).ravel(), at[-1])
    pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw)))
    prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, len(pieces), 3))) for k in range(3))
    spm = h[:, 3] % 100 < spm_share
    p, s, m = (pa.scalar(x, pa.large_string()) for x in MARKS)
    none = pa.scalar("", pa.large_string())
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(pa.array(plain), words.cast(pa.large_string()), pc.if_else(pa.array(spm), spm_text, psm_text))
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    chars = [units.chars.rank(x) for x in (at[:-1], one, two)]
    lengths = [pa.array(chars[k + 1] - chars[k], pa.int64(), mask=plain) for k in range(2)]
    return pa.array(n, pa.int64()), form, *lengths, output.cast(pa.string())


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of; no mark of its text can be met, as texts with marks stay plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "|".join(MARKS))
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of all documents."""
    got = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
k AS (
  SELECT *, len(units) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS hs FROM d),
c AS (
  SELECT doc_id, text, units, n, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 50 THEN 'plain'
              WHEN hs[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM k),
p AS (
  SELECT *, coalesce(array_to_string(units[:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
