"""Alignment of two tokenizers' tokens over the bytes of the same texts.

Token A is of a byte-level BPE file, token B of a SentencePiece model.  Both see
a blank put before the text.  Neither joins a blank to the word before it, so
the distinct stretches between such blanks are encoded once a batch.  The tokens
of a batch are then met by ``merge_asof``, keyed by document.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx
from capture_spark.llm.tables import fresh, settled, stored

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = "/opt/tokenizers/piece_bpe_32k.model"
SLICE = 3 << 19
LONG = 4096  # bytes of a stretch from which the regular expression of the fast encoder is not used
CACHED = 1 << 16  # stretches that a worker knows before it forgets them
HEAVY = 1 << 20  # id pairs whose counts are broadcast, 17 bytes each; the others are joined
TOGETHER = 256  # rows whose links are taken at once
KEPT = 1 << 22  # distinct pairs that a task holds before it gives them on
# The split of the byte-level vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MADE = ("ids_a", "ids_b", "n_a", "n_b", "n_groups", "n_links", "groups", "links")


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones are themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """Encoder of a byte-level BPE file, and the bytes of its tokens.

    Where ids follow the order of merges, a stretch is encoded by ranks; long
    stretches and other files go through the library that reads the file.
    """

    def __init__(self, data: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(data)
        self.whole.encode_special_tokens = True
        spec = json.loads(data)
        vocabulary, signs = spec["model"]["vocab"], byte_signs()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        self.raw: list[bytes] = [b""] * self.whole.get_vocab_size()
        for name, i in vocabulary.items():
            self.raw[i] = b"" if name in special else bytes(signs[c] for c in name)
        merges = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        split = spec.get("pre_tokenizer") or {}
        self.fast = None
        if merges == sorted(set(merges)) and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]:
            import tiktoken

            ranks = {x: i for i, x in enumerate(self.raw) if x}
            self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str], sizes: np.ndarray) -> list[list[int]]:
        if self.fast is None:
            return [e.ids for e in self.whole.encode_batch(texts, add_special_tokens=False)]
        return [self.whole.encode(t, add_special_tokens=False).ids if s > LONG else self.fast.encode_ordinary(t) for t, s in zip(texts, sizes, strict=True)]


class Pieces:
    """Encoder of a SentencePiece model, and the bytes of its tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        p = self.model
        self.raw = [b"" if p.is_control(i) or p.is_unknown(i) else bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in range(p.vocab_size())]
        if any("▁" in p.id_to_piece(i).lstrip("▁") for i in range(p.vocab_size())):
            raise ValueError("pieces across blanks: texts can't be encoded by stretches")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The model puts the first blank itself, though not before an empty text, which a lone blank leaves."""
        got = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids or [self.model.piece_to_id("▁")] for ids in got]


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of runs, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def stretches(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where to cut: at each text, and at blanks after what is surely no white space in any script."""
    first = np.zeros(len(raw), bool)
    ahead = np.zeros(len(raw) + 3, np.uint8)
    ahead[3:] = raw  # ahead[k] is the third byte before raw[k]
    one, two, three = ahead[2:-1], ahead[1:-2], ahead[:-3]
    odd = (two == 0xC2) | ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80))
    first[:] = (raw == 0x20) & (one > 0x20) & ~(odd & (one > 0x7F))
    first[at[:-1]] = True
    return np.flatnonzero(first)


class Side:
    """The tokens of one tokenizer over some texts: ids, the text and the first byte of each."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray, sizes: np.ndarray):
        self.ids, self.doc = ids, doc
        self.end = np.cumsum(sizes[ids])
        self.start = self.end - sizes[ids]

    def frame(self, name: str) -> pd.DataFrame:
        return pd.DataFrame({"at": self.start, "doc": self.doc, name: np.arange(len(self.ids))})


class Aligner:
    def __init__(self, a: str, b: bytes):
        self.a, self.b = ByteLevel(a), Pieces(b)
        self.sizes = [np.array([len(x) for x in side.raw], np.int64) for side in (self.a, self.b)]
        self.bytes = [pa.array(side.raw, pa.binary()) for side in (self.a, self.b)]
        n_a, n_b = len(self.a.raw), len(self.b.raw)
        ends = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self.signs = pa.array([f"{i}{c}" for n, c in ends for i in range(n)], pa.large_string())
        self.n_a, self.n_b = n_a, n_b
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def same_bytes(self, ids: np.ndarray, counts: np.ndarray, k: int, raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which stretches the tokens give back."""
        ends = np.cumsum(counts)
        sums = np.concatenate([[0], np.cumsum(self.sizes[k][ids])])
        same = sums[ends] - sums[ends - counts] == sizes
        back = np.frombuffer(self.bytes[k].take(pa.array(ids)).buffers()[2] or b"", np.uint8)[: sums[-1]]
        to = np.cumsum(sizes)
        good = np.flatnonzero(same)
        mine, theirs = ragged(sums[ends - counts][good], sizes[good]), ragged((to - sizes)[good], sizes[good])
        wrong = np.flatnonzero(back[mine] != raw[theirs])
        same[np.searchsorted(to, theirs[wrong], "right")] = False
        return same

    def learn(self, spelled: list[str]) -> None:
        """Put the ids of stretches on both sides into ``known``, and whether both give it back."""
        data = [w.encode() for w in spelled]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), np.uint8)
        same, packed = np.ones(len(data), bool), []
        for k, got in enumerate((self.a.encode(spelled, sizes), self.b.encode(spelled))):
            counts = np.fromiter(map(len, got), np.int64, len(got))
            packed.append([array("i", ids).tobytes() for ids in got])
            same &= self.same_bytes(np.frombuffer(b"".join(packed[k]), np.int32).astype(np.int64), counts, k, flat, sizes)
        self.known.update(zip(spelled, zip(*packed, same.tolist(), strict=True), strict=True))

    def encode(self, texts: pa.Array) -> tuple[Side, Side, np.ndarray]:
        """Both sides' tokens of the texts that both give back, and which these are."""
        kept = np.asarray(pc.fill_null(pc.not_equal(texts, ""), False))
        led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.if_else(pa.array(kept), texts, "").cast(pa.large_string()), pa.scalar("", pa.large_string()))
        at = np.frombuffer(led.buffers()[1], np.int64)[: len(led) + 1]
        raw = np.frombuffer(led.buffers()[2], np.uint8)[: at[-1]]
        cuts = stretches(raw, at)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(np.append(cuts, len(raw))), pa.py_buffer(raw)])
        found = pieces.dictionary_encode()
        which, words = found.indices.to_numpy(), found.dictionary
        spelled = words.cast(pa.large_string()).to_pylist()
        self.learn([w for w in spelled if w not in self.known])
        text_of = np.searchsorted(at, cuts, "right") - 1
        met = [self.known[w] for w in spelled]
        same, sides = np.fromiter((m[2] for m in met), bool, len(met)), []
        for k in range(2):
            counts = np.fromiter((len(m[k]) for m in met), np.int64, len(met)) >> 2
            sides.append((np.frombuffer(b"".join([m[k] for m in met]), np.int32).astype(np.int64), counts))
        if len(self.known) > CACHED or max(map(len, spelled), default=0) > LONG:
            self.known = {}
        np.logical_and.at(kept, text_of, same[which])
        out = []
        use = kept[text_of]
        for k, (ids, counts) in enumerate(sides):
            mine, n = which[use], counts[which[use]]
            out.append(Side(ids[ragged((np.cumsum(counts) - counts)[mine], n)], np.repeat(text_of[use], n), self.sizes[k]))
        return *out, kept

    def align(self, texts: pa.Array) -> list[pa.Array]:
        """The columns of ``MADE`` for a batch."""
        n = len(texts)
        a, b, _ = self.encode(texts)
        # Each token's start lies in one token of the other side; equal starts are met from both.
        of_a = pd.merge_asof(a.frame("a"), b.frame("b"), on="at", by="doc")
        of_b = pd.merge_asof(b.frame("b"), a.frame("a"), on="at", by="doc")
        of_b = of_b[a.start[of_b["a"].to_numpy(np.int64)] != of_b["at"].to_numpy()]
        link_a = np.concatenate([of_a["a"], of_b["a"]]).astype(np.int64)
        link_b = np.concatenate([of_a["b"], of_b["b"]]).astype(np.int64)
        links = np.concatenate([of_a["doc"], of_b["doc"]]).astype(np.int64)
        n_links = np.bincount(links, minlength=n)
        pairs = a.ids[link_a] * self.n_b + b.ids[link_b]
        size = self.n_a * self.n_b
        pairs = np.sort(links * size + pairs) - np.repeat(np.arange(n) * size, n_links)
        # Ends of both sides close groups; a group's A tokens come first, then its B tokens.
        other = np.minimum(np.searchsorted(b.end, a.end), max(len(b.end) - 1, 0))
        closes_a, closes_b = b.end[other] == a.end, np.zeros(len(b.ids), bool)
        closes_b[other[closes_a]] = True
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        ends_a, ends_b = np.flatnonzero(closes_a) + 1, np.flatnonzero(closes_b) + 1
        order = np.empty(len(a.ids) + len(b.ids), np.int64)
        order[np.arange(len(a.ids)) + np.append(0, ends_b)[group_a]] = a.ids + self.n_a * closes_a
        order[np.arange(len(b.ids)) + ends_a[group_b]] = b.ids + 2 * self.n_a + self.n_b * closes_b
        signs = self.signs.take(pa.array(order))
        at = np.frombuffer(signs.buffers()[1], np.int64)[: len(order) + 1]
        n_a, n_b = np.bincount(a.doc, minlength=n), np.bincount(b.doc, minlength=n)
        to = at[np.cumsum(n_a + n_b)]
        start = np.append(0, to)[:-1]
        cuts = np.append(np.stack([start, np.maximum(to - 1, start)], axis=1).ravel(), to[-1] if n else 0)
        groups = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(cuts), signs.buffers()[2] or pa.py_buffer(b"")).take(pa.array(np.arange(0, 2 * n, 2))).cast(pa.string())
        n_groups = np.bincount(a.doc[closes_a], minlength=n)
        ids = [tx.list_array(side.ids.astype(np.int32), np.cumsum(k), pa.int32()) for side, k in ((a, n_a), (b, n_b))]
        return [*ids, *[pa.array(k, pa.int64()) for k in (n_a, n_b, n_groups, n_links)], groups, tx.list_array(pairs, np.cumsum(n_links), pa.int64())]


_of_worker: dict[tuple[str, bytes], Aligner] = {}


def of_worker(a: str, b: bytes) -> Aligner:
    """The aligner that a Python worker keeps from task to task."""
    if (a, b) not in _of_worker:
        _of_worker.clear()
        _of_worker[a, b] = Aligner(a, b)
    return _of_worker[a, b]


def aligned(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, text: str = "text") -> DataFrame:
    """Add the columns of ``MADE`` to each row: what both tokenizers make of the text after a blank.

    ``ids_a`` and ``ids_b`` are the tokens.  A group ends where tokens of both end;
    ``groups`` lists them as ``a1,a2|b1;a3|b2,b3``.  A link is a pair of tokens whose
    bytes overlap; ``links`` has one number for each, A id * size of B + B id, in
    order of these.  Special tokens' strings in a text are plain text.

    One pass without a shuffle, by slices of 1.5 MB; a longer text stands alone and
    costs by its length.  A text that is null or empty, or that one of the
    tokenizers doesn't give back byte by byte, has no tokens.  Repeated rows are
    aligned each, an empty table gives no rows, extra columns ride along, and
    those with these names are replaced.
    """
    with open(model_a, encoding="utf-8") as f:
        a = f.read()
    with open(model_b, "rb") as f:
        b = f.read()
    source = docs.select(*[c for c in docs.columns if c not in MADE])
    types = ["array<int>", "array<int>", "long", "long", "long", "long", "string", "array<long>"]
    schema = source.withColumns({c: F.lit(None).cast(t) for c, t in zip(MADE, types, strict=True)}).schema
    at = source.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = of_worker(a, b)
        for batch in tx.slices(batches, text, SLICE):
            yield pa.RecordBatch.from_arrays([*batch.columns, *aligner.align(batch.column(at))], names=schema.fieldNames())
        aligner.known = {}  # the worker goes on to other stages

    return source.mapInArrow(run, schema)


def _links(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a batch's lists, and each one's row."""
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))


def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, some ``TOGETHER`` of them at once, as rows have many links."""
    for b in batches:
        for start in range(0, b.num_rows, TOGETHER):
            yield b.slice(start, TOGETHER)


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(link, n_docs, best): in how many rows each id pair is linked, and whether no pair of its A id is in more.

    Counted within a task first, so that a pair moves once a task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def summed() -> None:
            keys, of = np.unique(np.concatenate(links), return_inverse=True)
            sums = np.bincount(of, np.concatenate(counts), len(keys)).astype(np.int64)
            links[:], counts[:] = [keys], [sums]

        for b in parted(batches):
            link, row = _links(b.column(0))
            new = np.ones(len(link), bool)
            new[1:] = (link[1:] != link[:-1]) | (row[1:] != row[:-1])  # a row's links are in order
            keys, n = np.unique(link[new], return_counts=True)
            links.append(keys)
            counts.append(n)
            if sum(map(len, links)) > 2 * max(KEPT >> 3, len(links[0])):
                summed()
            if len(links[0]) > KEPT:
                yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(counts[0])], names=["link", "n_docs"])
                links[:], counts[:] = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        summed()
        yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(counts[0])], names=["link", "n_docs"])

    counted = rows.select("links").mapInArrow(count, "link long, n_docs long").groupBy("link").agg(F.sum("n_docs").alias("n_docs"))
    counted = stored(counted.withColumn("a", F.expr(f"link div {size_b}")), "pairs")
    best = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return stored(counted.join(best, "a").select("link", "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "pairs")


def pair_sums(rows: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, heavy: int = HEAVY) -> DataFrame:
    """Replace ``links`` of aligned rows by ``n_best`` (long) and ``count_sum`` (long).

    A pair's count is the number of rows that hold it linked; ``count_sum`` sums
    it over a row's links, and ``n_best`` are the links whose count is the highest of
    their A id, ties included.  The counts of the ``heavy`` commonest pairs are
    broadcast, those of the others are met by a join on the pair; ``heavy`` bounds
    what is broadcast and changes no result.  Rows without links have zeros;
    repeated rows count each; other columns ride along.
    """
    import sentencepiece

    spark = rows.sparkSession
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_b).vocab_size()

    def make() -> DataFrame:
        key = fresh("row_key", rows)
        source = stored(rows.drop("n_best", "count_sum").withColumn(key, F.monotonically_increasing_id()), "aligned")
        pairs = pair_counts(source, size_b)
        top = pairs.orderBy(F.desc("n_docs"), "link").limit(heavy).toArrow().sort_by("link")
        known = spark.sparkContext.broadcast(tuple(top.column(c).to_numpy() for c in ("link", "n_docs", "best")))
        columns = [c for c in source.columns if c != "links"]
        schema = source.select(*columns).withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).schema

        def looked_up(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            link, row = _links(batch.column(batch.schema.get_field_index("links")))
            keys = known.value[0]
            at = np.searchsorted(keys, link)
            at[at == len(keys)] = 0
            return link, row, at, keys[at] == link if len(keys) else np.zeros(len(link), bool)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, n_docs, best = known.value
            for batch in parted(batches):
                _, row, at, hit = looked_up(batch)
                made = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(made[0], row[hit], best[at[hit]])
                np.add.at(made[1], row[hit], n_docs[at[hit]])
                yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in columns], *map(pa.array, made)], names=schema.fieldNames())

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in parted(batches):
                link, row, _, hit = looked_up(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[~hit])), pa.array(link[~hit])], names=["row", "link"])

        rare = source.select(key, "links").mapInArrow(others, "row long, link long")
        rare = rare.join(pairs, "link").groupBy("row").agg(F.sum(F.col("best").cast("long")).alias("rare_best"), F.sum("n_docs").alias("rare_sum"))
        rare = rare.select(F.col("row").alias(key), F.col("rare_best").alias(fresh("rare_best", source)), F.col("rare_sum").alias(fresh("rare_sum", source)))
        got = source.mapInArrow(sums, schema).join(rare, key, "left")
        more = [F.coalesce(F.col(c), F.lit(0)) for c in rare.columns[1:]]
        return got.select(*[c for c in columns if c != key], (F.col("n_best") + more[0]).alias("n_best"), (F.col("count_sum") + more[1]).alias("count_sum"))

    return settled(spark, "pair_sums", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of all documents."""
    got = aligned(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    got = pair_sums(got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", digest.alias("groups_sha256"), "links"))
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
