"""Removal of long word sequences that the corpus holds more than once."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx
from capture_spark.llm.tables import fresh, measured_broadcasts, settled, stored

WINDOW = 35
GRAM = 8


def _selected(w: tx.Words, window: int, gram: int) -> tuple[tx.Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """Rolling word hashes, window starts, the place of each window's least gram (leftmost), and gram hashes."""
    rolling = tx.Rolling(w.hashes())
    starts = w.windows(window)
    if not len(starts):
        return rolling, starts, starts, np.zeros(0, np.uint64)
    n = len(w.start) - gram + 1
    at = np.arange(n)
    grams = rolling.spans(at, at + gram)
    low = (grams & ~np.uint64(2**31 - 1)) | at.astype(np.uint64)
    width, have = window - gram + 1, 1
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    low = np.minimum(low[: n - width + 1], low[width - have : width - have + n - width + 1])
    return rolling, starts, (low[starts] & np.uint64(2**31 - 1)).astype(np.int64), grams


def fingerprints(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(print, key): hashes of the least gram of each window of each row, once per place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            w = tx.Words(b.column(1))
            _, _, least, grams = _selected(w, window, gram)
            at = np.unique(least)
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64) if len(at) else np.zeros(0, np.int64)), b.column(0).take(pa.array(w.text[at]))], names=["print", "key"])

    return docs.select("key", "text").mapInArrow(run, "print long, key binary")


def _windows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(window, check, node, start, copies): two hashes of each window whose least gram is in ``prints``, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "text"):
            w = tx.Words(b.column(1))
            rolling, starts, least, grams = _selected(w, window, gram)
            other = tx.Rolling(w.hashes(tx.SECOND))
            prints = b.column(3)
            flat = prints.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            owner = np.repeat(np.arange(w.n), np.diff(prints.offsets.to_numpy()))
            salt = tx.mix(np.arange(1, w.n + 1, dtype=np.uint64))
            if len(starts):
                good = np.isin(grams[least] ^ salt[w.text[starts]], flat ^ salt[owner])
                starts = starts[good]
            text = w.text[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rolling.spans(starts, starts + window).view(np.int64)), pa.array(other.spans(starts, starts + window).view(np.int64)), b.column(0).take(pa.array(text)), pa.array((starts - w.first[text]).astype(np.int32)), b.column(2).take(pa.array(text))],
                names=["window", "check", "node", "start", "copies"],
            )

    return texts.select("node", "text", "copies", "prints").mapInArrow(run, "window long, check long, node long, start int, copies long")


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, text, starts): distinct texts with a repeated window, the starts of these; key is the text's MD5.

    Each window of ``window`` words names the least hashed gram of ``gram`` words
    in it.  Equal windows name equal grams, so only windows whose gram occurs at
    two places in the corpus or more can repeat; those are then counted by two
    64-bit hashes of all their words.  What a join meets on the other side is
    written first, so that Spark splits the rows of a very common gram or window.
    Equal texts are brought together before they move and count as often as
    they occur.  ``starts`` is null for a text with copies:
    all its windows repeat.
    """
    body = F.coalesce("text", F.lit(""))
    keyed = docs.select(body.alias("text"), F.unhex(F.md5(body)).alias("key"))
    prints = stored(fingerprints(keyed, window, gram), "prints")
    twice = stored(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"), "common-prints")
    shared = prints.join(twice, "print").groupBy("key").agg(F.collect_set("print").alias("prints"))
    distinct = keyed.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts = stored(distinct.join(shared, "key").withColumn("node", F.monotonically_increasing_id()), "passages")
    windows = _windows(texts, window, gram)
    counts = stored(windows.groupBy("window", "check").agg(F.sum("copies").alias("n")).filter("n > 1").select("window", "check"), "common-windows")
    single = windows.filter("copies = 1").drop("copies")
    found = single.join(counts, ["window", "check"]).groupBy("node").agg(F.collect_list("start").alias("starts"))
    return texts.join(found, "node", "left").filter("starts IS NOT NULL OR copies > 1").select("key", "text", "starts")


def _kept(texts: DataFrame, window: int, out: str, make) -> DataFrame:
    """Apply ``make(words, kept)`` to each row of (key, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            rows = []
            for text, starts in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                words = text.encode().split()
                if starts.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + window, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                else:
                    keep = np.full(len(words), len(words) < window)
                rows.append(make(words, keep))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["key", "n_removed", "kept"])

    return texts.mapInArrow(run, out)


def _digest(words: list[bytes], keep: np.ndarray) -> tuple[int, str]:
    return int((~keep).sum()), hashlib.sha256(b" ".join(compress(words, keep))).hexdigest()


def _text(words: list[bytes], keep: np.ndarray) -> tuple[int, str]:
    return int((~keep).sum()), b" ".join(compress(words, keep)).decode()


def removed(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of ``docs``.

    Every word covered by a window of ``window`` words whose word sequence starts
    anywhere else too, in the same text or another, is removed, at all its
    places; windows are judged on the input.  Null and blank texts have no
    words; shorter texts lose none; repeated rows count as copies; null ids and
    extra columns are allowed.  A text of any length is judged whole.
    """
    with measured_broadcasts(docs.sparkSession):
        found = settled(docs.sparkSession, "removed", lambda: _kept(repeated_words(docs, window, gram), window, "key binary, n_removed long, kept string", _digest))
    found = found.select(F.col("key").alias("of_key"), F.col("n_removed").alias("gone"), "kept")
    body = F.coalesce("text", F.lit(""))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            words = [t.encode().split() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(x) for x in words], pa.int64()), pa.array([hashlib.sha256(b" ".join(x)).hexdigest() for x in words])], names=["doc_id", "key", "n_words", "whole"]
            )

    rows = docs.select("doc_id", F.unhex(F.md5(body)).alias("key"), body.alias("text")).mapInArrow(whole, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, n_words long, whole string")
    out = rows.join(found, rows["key"] == found["of_key"], "left")
    return out.select("doc_id", "n_words", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


def cut(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``; a text that loses words has the rest joined by blanks.

    ``n_chars``, where there is such a column, is counted anew for these texts.
    Null, empty and short texts stay as they are; a repeated row is a copy and
    loses all its words (35 or more), as the other does; null ids and columns of
    any name are allowed; an empty table gives no rows.
    """
    with measured_broadcasts(docs.sparkSession):
        found = settled(docs.sparkSession, "cut", lambda: _kept(repeated_words(docs, window, gram), window, "key binary, n_removed long, kept string", _text).filter("n_removed > 0"))
    key, of, kept = fresh("cut_key", docs), fresh("of_key", docs), fresh("kept_text", docs)
    out = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    out = out.join(found.select(F.col("key").alias(of), F.col("kept").alias(kept)), F.col(key) == F.col(of), "left")
    out = out.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM d),
g AS (SELECT doc_id, i, w, CASE WHEN i + 34 <= n THEN hash(array_to_string(list(w) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING), ' ')) END AS g FROM x),
t AS (SELECT doc_id, i, w, g IS NOT NULL AND count(*) OVER (PARTITION BY g) > 1 AS twice FROM g),
c AS (SELECT doc_id, i, w, max(CAST(twice AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) = 1 AS gone FROM t),
k AS (SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""
