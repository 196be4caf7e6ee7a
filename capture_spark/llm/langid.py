"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to four bytes.  A byte costs the
code length that its longest known context gives it (count over the context's
total plus its distinct bytes); a context that never saw the byte costs an
escape (distinct over the same) and hands on to the context one byte shorter, down
to 8 bits for any byte.  The counts are frozen, so a byte's cost depends on it
and the four bytes before it alone, and is an integer of 2**-16 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx
from capture_spark.llm.tables import fresh, settled, stored

ORDER = 4
SAMPLE = 8 << 20  # bytes of training text of a language, as expected
CELLS = 1 << 22  # costs in the model, for strings of five bytes times languages
LANGUAGES = 64
UNIT = 1 << 16  # parts of a bit
TIMES = 4096  # counts that are told apart where the commonest strings are chosen
SLICE = 1 << 20
UNDECIDED = "und"
MADE = ("held_out", "lang_pred", "score", "bits")

_U = np.uint64


class Lookup:
    """Places of keys in a sorted array, by a table of first places and steps to the next."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = _U(64 - max(4, int(len(keys) * 4).bit_length()))
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            again = self.table[slot] != left
            left, slot = left[again], (slot[again] + 1) & (len(self.table) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 where it is unknown."""
        slot = self._slots(keys)
        out = self.table[slot]
        at = np.flatnonzero((out >= 0) & (self.keys[out] != keys)) if len(self.keys) else np.zeros(0, np.int64)
        slot = slot[at]
        while len(at):
            slot = (slot + 1) & (len(self.table) - 1)
            found = self.table[slot]
            out[at] = found
            wrong = (found >= 0) & (self.keys[found] != keys[at])
            at, slot = at[wrong], slot[wrong]
        return out


class Trees:
    """The context trees of all languages: costs of the strings that any of them has met, and of escapes from contexts."""

    def __init__(self, names: list[str], shares: np.ndarray, lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.names = names
        self.prior = np.rint(-np.log2(shares) * UNIT).astype(np.int64)
        n = len(names)
        self.grams: list[Lookup] = []
        self.contexts: list[Lookup] = []
        self.costs: list[np.ndarray] = []  # by length of the context: [language, string]
        self.escapes: list[np.ndarray] = []  # and [language, context]
        below = np.full((n, 256), 8.0)
        for order in range(ORDER + 1):
            keys, of = np.unique(gram & _U((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(lang * len(keys) + of, count, n * len(keys)).reshape(n, len(keys)).astype(float)
            contexts, start = np.unique(keys >> _U(8), return_index=True)
            sums = [np.add.reduceat(x, start, axis=1) if len(keys) else np.zeros((n, 0)) for x in (counts, counts > 0)]
            total, distinct = (x.astype(np.float64) for x in sums)
            escape = np.where(total > 0, np.log2(np.maximum(total + distinct, 1) / np.maximum(distinct, 1)), 0.0)
            row = np.repeat(np.arange(len(contexts)), np.diff(np.append(start, len(keys))))
            shorter = below[:, self.grams[-1].find(keys & _U((1 << 8 * order) - 1))] if order else below[:, keys.astype(np.int64)]
            own = np.log2((total + distinct)[:, row] / np.maximum(counts, 1), where=counts > 0, out=np.zeros_like(counts))
            below = np.where(counts > 0, own, escape[:, row] + shorter)
            self.grams.append(Lookup(keys))
            self.contexts.append(Lookup(contexts))
            self.costs.append(np.rint(below * UNIT).astype(np.int32))
            self.escapes.append(np.rint(escape * UNIT).astype(np.int32))
            below = self.costs[-1] / UNIT

    def code_lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """[language, text] bits of texts that each stand after ``ORDER`` line ends, in parts of ``UNIT``."""
        out = np.zeros((len(self.names), len(at) - 1), np.int64)
        for first in range(0, len(raw) - ORDER, SLICE):
            last = min(first + SLICE, len(raw) - ORDER)
            gram = strings(raw[first : last + ORDER])
            doc = np.searchsorted(at, np.arange(first + ORDER, last + ORDER), "right") - 1
            own = np.arange(first, last) >= at[doc]
            gram, doc = gram[own], doc[own]
            low = doc[0] if len(doc) else 0
            self._add(out[:, low:], gram, doc - low)
        return out

    def _add(self, out: np.ndarray, gram: np.ndarray, doc: np.ndarray) -> None:
        """Costs of strings by their longest known ending; sums stay whole numbers below 2**53."""
        for order in range(ORDER, -1, -1):
            place = self.grams[order].find(gram & _U((1 << 8 * (order + 1)) - 1))
            known = place >= 0
            for cost, sums in zip(self.costs[order], out, strict=True):
                n = np.bincount(doc[known], cost[place[known]])
                sums[: len(n)] += n.astype(np.int64)
            gram, doc = gram[~known], doc[~known]
            if not len(gram):
                return
            context = self.contexts[order].find((gram & _U((1 << 8 * (order + 1)) - 1)) >> _U(8))
            known = context >= 0
            for escape, sums in zip(self.escapes[order], out, strict=True):
                n = np.bincount(doc[known], escape[context[known]])
                sums[: len(n)] += n.astype(np.int64)
        n = np.bincount(doc)
        out[:, : len(n)] += n * 8 * UNIT

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language of the shortest code, its share of 2**-length over all languages, its bits."""
        bits = self.code_lengths(*led(texts)) + self.prior[:, None]
        best = bits.argmin(axis=0)  # the first name of equals
        least = bits.min(axis=0)
        share = 1 / np.exp2(np.maximum((least - bits) / UNIT, -1000.0)).sum(axis=0)
        return [self.names[k] for k in best], share, least / UNIT


def led(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes of texts, each after ``ORDER`` line ends, and where they start."""
    lower = pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    led = pc.binary_join_element_wise(pa.scalar("\n" * ORDER, pa.large_string()), lower, pa.scalar("", pa.large_string()))
    at = np.frombuffer(led.buffers()[1], np.int64)[: len(led) + 1]
    return np.frombuffer(led.buffers()[2] or b"", np.uint8)[: at[-1]], at


def strings(raw: np.ndarray) -> np.ndarray:
    """Each byte with the ``ORDER`` bytes before it as one number."""
    n = len(raw) - ORDER
    gram = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        gram = (gram << _U(8)) | raw[k : k + n]
    return gram


def _held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def trained(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, cells: int = CELLS, languages: int = LANGUAGES) -> Trees:
    """Context trees of the languages of all rows that aren't held out and have a text and a language.

    The sample is bounded: of a language with more than ``sample`` bytes only as many
    rows count, by a digest of id and text, as give that number.  Whole texts are
    taken.  Tasks count strings of five bytes first, so that a string moves once a task
    and language.  The ``languages`` with most text have trees, and each keeps its
    commonest strings, ``cells`` over the square of the languages at most: all that are met
    at least so often, by the least number for which they fit.  This bounds the model on
    the driver and in the broadcast.
    """
    rows = docs.filter(~_held_out(doc_id) & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    sizes = rows.groupBy(F.col(lang).alias("lang")).agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("n")).orderBy(F.desc("bytes"), "lang").limit(languages).collect()
    sizes = sorted(sizes, key=lambda r: r["lang"])
    names = [r["lang"] for r in sizes]
    if not names:
        return Trees([], np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))
    code = F.lit(-1)
    for k, r in enumerate(sizes):
        share = min(1 << 30, (sample << 30) // r["bytes"])
        draw = F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1 << 30))
        code = F.when((F.col(lang) == r["lang"]) & (draw < share), k).otherwise(code)
    picked = rows.select(code.alias("code"), F.col(text).alias("text")).filter("code >= 0")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]

        def summed() -> None:
            found, of = np.unique(np.concatenate(keys), return_inverse=True)
            counts[:] = [np.bincount(of, np.concatenate(counts), len(found)).astype(np.int64)]
            keys[:] = [found]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array((keys[0] >> _U(40)).astype(np.int32)), pa.array((keys[0] & _U((1 << 40) - 1)).astype(np.int64)), pa.array(counts[0])], names=["code", "gram", "n"])

        for b in tx.slices(batches, "text", SLICE):
            raw, at = led(b.column(1))
            for first in range(0, len(raw) - ORDER, 4 * SLICE):
                last = min(first + 4 * SLICE, len(raw) - ORDER)
                doc = np.searchsorted(at, np.arange(first + ORDER, last + ORDER), "right") - 1
                own = np.arange(first, last) >= at[doc]
                of = b.column(0).to_numpy()[doc[own]].astype(np.uint64)
                found, n = np.unique(strings(raw[first : last + ORDER])[own] | of << _U(40), return_counts=True)
                keys.append(found)
                counts.append(n)
            if sum(map(len, keys)) > 2 * max(1 << 20, len(keys[0])):
                summed()
            if len(keys[0]) > 1 << 22:
                yield out()
                keys[:], counts[:] = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        summed()
        yield out()

    most = max(256, cells // len(names) ** 2)

    def common() -> DataFrame:
        counted = stored(picked.mapInArrow(count, "code int, gram long, n long").groupBy("code", "gram").agg(F.sum("n").alias("n")), "strings")
        counts = counted.groupBy("code", F.least("n", F.lit(TIMES)).alias("n")).count().collect()  # at most TIMES rows a language
        enough = F.lit(False)
        for k in range(len(names)):
            fits, least = 0, TIMES + 1
            for r in sorted((r for r in counts if r["code"] == k), key=lambda r: -r["n"]):
                fits += r["count"]
                least = r["n"] if fits <= most or least > TIMES else least
            enough = enough | ((F.col("code") == k) & (F.col("n") >= least))
        return counted.filter(enough)

    kept = settled(docs.sparkSession, "strings", common)
    table = kept.toArrow().sort_by([("code", "ascending"), ("gram", "ascending")])
    shares = np.array([r["n"] for r in sizes], float)
    return Trees(names, shares / shares.sum(), table.column("code").to_numpy().astype(np.int64), table.column("gram").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(np.float64))


def predicted(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", **bounds: int) -> DataFrame:
    """Add ``held_out``, ``lang_pred``, ``score`` and ``bits`` to each row.

    ``held_out`` rows (crc32 of the id as text divisible by 5) teach nothing; the
    others do, as ``trained`` says.  The prediction reads the text alone: the language
    whose tree gives the lower-case text the shortest code, its language's own code
    length by share of training rows included.  ``score`` is its 2**-length over the sum of
    all languages', ``bits`` the length.  Sums are of integers, so partitions don't
    change them; of equal lengths the first name wins.

    A text that is null or has no letter, and any text where nothing teaches, is ``und``
    with score 0 and null bits.  A null id is hashed as an empty string (held out).
    Very long texts are taken by blocks.  Repeated rows get the same; an empty table
    gives no rows; extra columns ride along, and those with these names are replaced.
    """
    trees = docs.sparkSession.sparkContext.broadcast(trained(docs, text, lang, doc_id, **bounds))
    source = docs.select(*[c for c in docs.columns if c not in MADE])
    lettered = fresh("lettered", source)
    schema = source.withColumns({"held_out": F.lit(True), "lang_pred": F.lit("").cast("string"), "score": F.lit(0.0), "bits": F.lit(0.0)}).schema
    for f in schema.fields[-4:]:
        f.nullable = True
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = trees.value
        for b in tx.slices(batches, text, SLICE):
            some = b.column(b.num_columns - 1)
            if model.names:
                names, share, bits = model.predict(pc.if_else(some, b.column(at), ""))
            else:
                some = pa.array(np.zeros(b.num_rows, bool))
                names, share, bits = [""] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows)
            columns = [pc.if_else(some, pa.array(names, pa.string()), UNDECIDED), pc.if_else(some, pa.array(share), 0.0), pc.if_else(some, pa.array(bits), pa.scalar(None, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=schema.fieldNames())

    ready = source.withColumns({"held_out": _held_out(doc_id), lettered: F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))})
    return ready.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return predicted(docs).select("doc_id", "held_out", "lang_pred", "score")
