"""Repetition rules: how much of a text lies inside repeated lines and n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from capture_spark.llm import text as tx

SYMBOLS = "#*$%&|<>"
LENGTHS = (5, 6, 7, 8, 9, 10)
WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Shares of the characters in words above which a text is turned away."""

    dup_lines: float = 0.30
    symbols: float = 0.05
    dup_ngrams: tuple[float, ...] = (0.50, 0.48, 0.46, 0.44, 0.42, 0.40)


MEASURES = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")]
    + [T.StructField(f"dup{n}_chars", T.LongType()) for n in LENGTHS]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def _measure(texts: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    w = tx.Words(texts)
    n = w.n
    solid = w.solid & ((w.raw & 0xC0) != 0x80)
    symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
    out = {"n_words": w.counts, "word_chars": tx.per_text(solid, w.at), "n_symbols": tx.per_text(symbol[w.raw], w.at)}
    salt = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    chars = np.concatenate([[0], np.cumsum(solid)])

    newline = np.flatnonzero(w.raw == 10)
    bounds = np.unique(np.concatenate([w.at, newline, newline + 1]))
    s, e = bounds[:-1], bounds[1:]
    if len(s):
        line = (w.raw[s] != 10) & (chars[e] > chars[s])
        s, e = s[line], e[line]
    owner = np.searchsorted(w.at, s, "right") - 1
    key = tx.mix(tx.span_hashes(w.data, s, e) ^ salt[owner])
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(s), bool)
    again[first] = False
    out["n_dup_lines"] = np.bincount(owner[again], minlength=n)
    out["dup_line_chars"] = np.bincount(owner[again], weights=(chars[e] - chars[s])[again], minlength=n).astype(np.int64)

    hashes = w.hashes()
    word_chars = chars[w.end] - chars[w.start]
    grams = tx.Rolling(hashes)
    alive = None  # starts of the repeated n-grams of the last length: a longer repeat needs them at both ends
    for size in LENGTHS:
        at = w.windows(size)
        if alive is not None:
            at = at[alive[at] & alive[np.minimum(at + 1, len(alive) - 1)]]
        twice = at[tx.repeated(tx.mix(grams.spans(at, at + size) ^ salt[w.text[at]]))]
        alive = np.zeros(len(w.start) + 1, bool)
        alive[twice] = True
        edge = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(edge, twice, 1)
        np.add.at(edge, twice + size, -1)
        inside = np.cumsum(edge[:-1]) > 0
        out[f"dup{size}_chars"] = tx.per_text(np.where(inside, word_chars, 0), w.first)
        if size == WINDOW:
            out["n_repeat_words"] = tx.per_text(inside, w.first)
    out["base_failed"] = (out["n_words"] < 20) | (100 * out["n_repeat_words"] > 30 * out["n_words"])
    total = np.maximum(out["word_chars"], 1)
    bad = out["base_failed"] | (out["dup_line_chars"] > limits.dup_lines * total) | (out["n_symbols"] > limits.symbols * total)
    for size, most in zip(LENGTHS, limits.dup_ngrams, strict=True):
        bad = bad | (out[f"dup{size}_chars"] > most * total)
    out["kept"] = ~bad
    return out


def repetition(docs: DataFrame, limits: Limits = Limits(), text: str = "text") -> DataFrame:
    """Add the measures and the verdict ``kept`` to each row of ``docs``.

    One pass without a shuffle.  For each length n of 5 to 10 words, rolling
    hashes find the n-grams that a text holds twice or more; ``dup{n}_chars``
    counts the characters of the words inside them, ``dup_line_chars`` those in
    lines equal to an earlier line.  A null or empty text has zero of all and
    fails for its length.  Characters of ``SYMBOLS`` above their share fail a text
    too.  Other columns, nulls in them and repeated rows pass
    through; of columns named like a measure, the measure stays.  A text of any
    length is measured whole, in memory of its own size.
    """
    keep = [c for c in docs.columns if c not in MEASURES.fieldNames()]
    source = docs.select(*keep)
    schema = T.StructType([*source.schema.fields, *MEASURES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, text):
            got = _measure(b.column(b.schema.get_field_index(text)), limits)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(got[f.name], pa.bool_() if isinstance(f.dataType, T.BooleanType) else pa.int64()) for f in MEASURES.fields]],
                names=schema.fieldNames(),
            )

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repetition(docs).drop("text")


def _sql() -> str:
    covers = []
    for n in LENGTHS:
        key = " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER o" for k in range(1, n)]])
        covers.append(
            f"g{n} AS (SELECT doc_id, i, n, count(*) OVER (PARTITION BY doc_id, g) > 1 AND g IS NOT NULL AS twice FROM (SELECT doc_id, i, n, {key} AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i))), "
            f"c{n} AS (SELECT doc_id, CAST(coalesce(sum(n) FILTER (WHERE covered), 0) AS BIGINT) AS chars, CAST(count(*) FILTER (WHERE covered) AS BIGINT) AS words FROM (SELECT doc_id, n, max(CAST(twice AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS covered FROM g{n}) GROUP BY doc_id)"
        )
    limits = Limits()
    chars = ", ".join(f"coalesce(c{n}.chars, 0) AS dup{n}_chars" for n in LENGTHS)
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.doc_id = d.doc_id" for n in LENGTHS)
    most = " AND ".join(f"dup{n}_chars <= CAST({x} AS DOUBLE) * greatest(word_chars, 1)" for n, x in zip(LENGTHS, limits.dup_ngrams, strict=True))
    word = r"[^\x20\x09-\x0D]+"
    blank = r"[\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, CAST(length(unnest(ws)) AS BIGINT) AS n FROM d),
{", ".join(covers)},
lines AS (SELECT doc_id, l, CAST(length(regexp_replace(l, '{blank}', '', 'g')) AS BIGINT) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{word}')),
dups AS (SELECT doc_id, CAST(sum(k - 1) AS BIGINT) AS n_dup_lines, CAST(sum(n * (k - 1)) AS BIGINT) AS dup_line_chars FROM (SELECT doc_id, l, any_value(n) AS n, count(*) AS k FROM lines GROUP BY doc_id, l) GROUP BY doc_id),
m AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{blank}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c{WINDOW}.words, 0) AS n_repeat_words, coalesce(dup_line_chars, 0) AS dup_line_chars, {chars} FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id {joins}),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= CAST({limits.dup_lines} AS DOUBLE) * greatest(word_chars, 1) AND n_symbols <= CAST({limits.symbols} AS DOUBLE) * greatest(word_chars, 1) AND {most} AS kept FROM b"""


ORACLE = _sql()
