"""MinHash near-duplicates by an inverted join on signature coordinates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx
from capture_spark.llm.graphs import components
from capture_spark.llm.tables import fresh, measured_broadcasts, settled, stored

SHINGLE = 4
PERCENT = 80
COORDINATES = 64
MATCHES = 35
SHARED = 5
CROWD = 64
COMMON = 1 << 16  # posts that come last in every node's order, at most
SAMPLED = 1 << 16  # nodes that common posts are told by
WANTED = 1 << 24  # bits that tell which texts are read again
BLOCK = 512
COLUMNS = 4096


def _shingles(texts: pa.Array, size: int) -> tuple[tx.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, shingle hashes and their texts (in order), and two hashes of each text's word sequence."""
    w = tx.Words(texts, lower=True)
    h = w.hashes()
    grams = tx.Rolling(h)
    at = w.windows(size)
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    values = np.concatenate([grams.spans(at, at + size), grams.spans(w.first[short], w.first[short + 1])])
    owner = np.concatenate([w.text[at], short])
    if len(short):
        order = np.argsort(owner, kind="stable")
        values, owner = values[order], owner[order]
    return w, values, owner, tx.sequence_hashes(h, w.first), tx.sequence_hashes(w.hashes(tx.SECOND), w.first, tx.SECOND)


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each text, sorted within it, and the running ends."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.cumsum(np.bincount(owner[new], minlength=n))


def _binary16(a: np.ndarray, b: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(np.stack([a, b], 1).astype(">u8"))
    offsets = np.arange(0, 16 * (len(a) + 1), 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def signatures(docs: DataFrame, size: int = SHINGLE, coordinates: int = COORDINATES, row: str | None = None) -> DataFrame:
    """(doc_id, key, row, seq, n_shingles, sig) per row: text digest, a number in column ``row``, word sequence digest, set size, minimum per coordinate."""
    odd = np.random.default_rng(7).integers(1, 2**63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    source = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("key"), "text", (F.col(row) if row else F.lit(0)).cast("long").alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            w, values, owner, one, two = _shingles(b.column(2), size)
            unique = tx.mix(values ^ tx.mix(np.arange(1, w.n + 1, dtype=np.uint64))[owner])
            _, first = np.unique(unique, return_index=True)
            counts = np.bincount(owner[first], minlength=w.n)
            full = np.flatnonzero(counts)
            least = np.zeros((len(full), coordinates), np.int32)
            if len(full):
                starts = np.searchsorted(owner, full)
                scratch = np.empty_like(values)
                for k, a in enumerate(odd):
                    np.multiply(values, a, out=scratch)
                    least[:, k] = (tx.mix(np.minimum.reduceat(scratch, starts) ^ (a << np.uint64(1))) >> np.uint64(33)).astype(np.int32)
            ends = np.cumsum(np.where(counts > 0, coordinates, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), _binary16(one, two), pa.array(counts, pa.int64()), tx.list_array(least.ravel(), ends, pa.int32())],
                names=["doc_id", "key", "row", "seq", "n_shingles", "sig"],
            )

    return source.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, row long, seq binary, n_shingles long, sig array<int>")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, shingles) of (node, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches):
            w, values, owner, _, _ = _shingles(b.column(1), size)
            values, ends = _distinct(values, owner, w.n)
            yield pa.RecordBatch.from_arrays([b.column(0), tx.list_array(values.view(np.int64), ends, pa.int64())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles array<long>")


def _common(nodes: DataFrame, coordinates: int, crowd: int) -> np.ndarray:
    """The commonest posts, the rarest of them first, as some ``SAMPLED`` nodes have them.

    They only set an order, so that neither the sample nor the limit changes which
    pairs are found, but how many others are tried.
    """
    n = nodes.count()
    share = min(1.0, SAMPLED / max(n, 1))
    some = nodes if share == 1 else nodes.filter(F.pmod(F.xxhash64("seq"), F.lit(1 << 20)) < round(share * (1 << 20)))
    posts = some.select(F.explode(F.transform("sig", lambda v, k: v.cast("long") * coordinates + k)).alias("pair"))
    counts = posts.groupBy("pair").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2, round(crowd * share / 2)))
    return counts.orderBy(F.col("n").desc(), "pair").limit(COMMON).select("pair").toArrow().column("pair").to_numpy()[::-1].copy()


def _posts(nodes: DataFrame, coordinates: int, prefix: int, crowd: int) -> DataFrame:
    """(node, pair): the first ``prefix`` posts of each node, common ones last."""
    common = _common(nodes, coordinates, crowd)
    places = np.argsort(common)
    shared = nodes.sparkSession.sparkContext.broadcast((common[places], places + 1))
    shift = 31 + coordinates.bit_length()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, places = shared.value
        for b in batches:
            pairs = b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, coordinates) * coordinates + np.arange(coordinates)
            if len(common):
                at = np.minimum(np.searchsorted(common, pairs), len(common) - 1)
                pairs += np.where(common[at] == pairs, places[at], 0) << shift
            if prefix < coordinates:
                pairs = np.partition(pairs, prefix - 1, axis=1)[:, :prefix]
            pairs &= (1 << shift) - 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), pairs.shape[1])), pa.array(pairs.ravel())], names=["node", "pair"])

    return nodes.select("node", "sig").mapInArrow(run, "node long, pair long")


def _matched(pairs: DataFrame, nodes: DataFrame, least: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough and whose set sizes allow a link."""
    a = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    b = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    return pairs.join(a, "a").join(b, "b").filter(sized & (equal >= least)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs whose full shingle sets overlap enough."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tx.slices([batch], "ta"):
                for c in tx.slices([part], "tb"):
                    sets = []
                    for column in (2, 3):
                        w, values, owner, _, _ = _shingles(c.column(column), size)
                        flat, ends = _distinct(values, owner, w.n)
                        counts = np.diff(np.concatenate([[0], ends]))
                        sets.append((flat, np.repeat(np.arange(w.n), counts), counts))
                    (va, oa, na), (vb, ob, nb) = sets
                    values, owner = np.concatenate([va, vb]), np.concatenate([oa, ob])
                    order = np.lexsort((values, owner))
                    values, owner = values[order], owner[order]
                    common = np.bincount(owner[1:][(values[1:] == values[:-1]) & (owner[1:] == owner[:-1])], minlength=c.num_rows)
                    good = pa.array(100 * common >= percent * (na + nb - common))
                    yield pa.RecordBatch.from_arrays([c.column(0).filter(good), c.column(1).filter(good)], names=["a", "b"])

    return pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, shared: int = SHARED, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Texts with the same word sequence are one node.  Each node posts under pairs
    of coordinate and minimum.  With the pairs of every node in one order,
    two nodes that agree in ``matches`` of ``coordinates`` share ``shared`` of
    their first coordinates - matches + shared, so only that prefix is posted,
    and a node with fewer of its posts in lists of two or more is skipped.  The
    order has common pairs last, the commonest at its end: a passage that many
    texts have makes no long list, unless little else is in them.  At
    the default figures two sets of Jaccard similarity 0.8 miss the threshold of
    matches once in a million pairs.

    A list is not expanded into all its pairs.  First every node is tried
    against the list's most connected node (the one whose lists are longest):
    collisions are counted on the whole signatures, and pairs at the threshold
    are confirmed on full shingle sets.  Then only nodes outside the component
    of that node are tried against the list: pair by pair in lists of under
    ``crowd`` nodes, and by blocks of nodes of like size in longer ones, where a task
    compares the full sets of two blocks and returns no more links than join them up.

    A null or blank text is linked with nothing, not even its like.  Rows
    without an id take the component of a row with an id and an equal or near
    text, else null, and are kept only then.  An empty table gives no rows.  Repeated rows and extra columns
    are allowed; all rows with the smallest id of a component are kept.
    """

    def make() -> DataFrame:
        table, classes = _classes(docs, None, size, percent, coordinates, matches, shared, crowd)
        out = table.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("seq")).alias("seq"))
        out = out.join(classes.select(F.col("seq").alias("of_seq"), "component_low"), F.col("seq") == F.col("of_seq"), "left")
        out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_low")).otherwise(F.col("doc_id")))
        return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))

    with measured_broadcasts(docs.sparkSession):
        return settled(docs.sparkSession, "near-duplicates", make)


def _classes(docs: DataFrame, row: str | None, size: int, percent: int, coordinates: int, matches: int, shared: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and (seq, component_low, component_first) for each word sequence that is not blank.

    ``component_low`` is the smallest id of the component, ``component_first`` the
    number of its first row in order of id (nulls last), text digest and number.
    """
    table = stored(signatures(docs, size, coordinates, row), "signatures")
    full = table.filter("n_shingles > 0")
    nodes = full.groupBy("seq").agg(F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min("key").alias("key"), F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "key", "row")).alias("first"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    posts = _posts(nodes, coordinates, coordinates - matches + shared, crowd)
    lists = posts.groupBy("pair").agg(F.count("*").alias("length")).filter("length > 1")
    live = stored(posts.join(lists, "pair").select("node", "pair"), "posts")
    able = live.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= shared).select("node")
    live = live.join(able, "node", "left_semi")
    lists = live.groupBy("pair").agg(F.count("*").alias("length")).filter("length > 1")
    live = stored(live.join(lists, "pair"), "live")

    weights = live.groupBy("node").agg(F.sum("length").alias("weight"))
    heads = live.join(weights, "node").groupBy("pair").agg(F.max(F.struct("weight", "node")).alias("top")).select("pair", F.col("top.node").alias("head"))
    heads = stored(heads, "heads")
    tried = live.join(heads, "pair").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    star = stored(_matched(tried, nodes, matches, percent), "star")

    # Full texts of the nodes that a pair or a crowded list has, once each.
    wanted = star.select(F.col("a").alias("node")).union(star.select("b")).union(live.filter(F.col("length") >= crowd).select("node")).distinct()
    texts = stored(_texts(docs, nodes, wanted), "texts")
    links = stored(_confirmed(star, texts, percent, size), "star-links")
    labels = components(links)

    placed = live.join(labels, "node", "left").select("pair", "length", "node", F.coalesce("comp", "node").alias("comp"))
    mains = heads.join(labels, heads["head"] == labels["node"], "left").select("pair", F.coalesce("comp", "head").alias("main"))
    placed = placed.join(mains, "pair")
    mixed = placed.filter("comp <> main").select("pair").distinct()
    placed = stored(placed.join(mixed, "pair", "left_semi").join(nodes.select("node", F.col("n_shingles").alias("n")), "node"), "mixed")
    few = placed.filter(F.col("length") < crowd)
    x = few.filter("comp <> main").select("pair", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = few.select("pair", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    cross = x.join(y, "pair").filter((F.col("ca") != F.col("cb")) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    cross = stored(_matched(cross, nodes, matches, percent), "cross")
    crowded = placed.filter(F.col("length") >= crowd)
    blocks = stored(_block_links(crowded, texts, percent, size), "block-links")
    if blocks.limit(1).count():
        links = links.union(blocks)
        labels = None
    if cross.limit(1).count():
        wanted = cross.select(F.col("a").alias("node")).union(cross.select("b")).distinct().join(texts, "node", "left_anti")
        if wanted.limit(1).count():
            texts = texts.union(stored(_texts(docs, nodes, wanted), "texts"))
        links = stored(links.union(_confirmed(cross, texts, percent, size)), "links-all")
        labels = None
    labels = labels or components(links)

    # Only nodes with links meet over their component; both sides are written, so a large component may be split.
    linked = stored(labels.join(nodes.select("node", "low", "first"), "node"), "linked")
    lows = stored(linked.groupBy("comp").agg(F.min("low").alias("component_low"), F.min("first").alias("component_first")), "component-lows")
    lows = linked.select("node", "comp").join(lows, "comp").drop("comp")
    lows = nodes.select("node", "seq", "low", "first").join(lows, "node", "left")
    own = F.col("component_first").isNull()
    return table, lows.select("seq", F.when(own, F.col("low")).otherwise(F.col("component_low")).alias("component_low"), F.when(own, F.col("first.row")).otherwise(F.col("component_first.row")).alias("component_first"))


def _block_links(crowded: DataFrame, texts: DataFrame, percent: int, size: int) -> DataFrame:
    """Links between nodes outside a main component and nodes of its lists.

    (a, b) rows that connect what the links of each pair of blocks connect.
    Blocks hold nodes of one band of set sizes; sizes of linked nodes differ by a
    band at most.
    """
    band = F.floor(F.log("n") / math.log(100 / percent * (1 + 1e-9))).cast("int") if percent < 100 else F.col("n").cast("int")
    ys = crowded.select("main", "node", band.alias("y_band")).distinct()
    xs = crowded.filter("comp <> main").select("main", "node", band.alias("x_band")).distinct()
    counts = xs.groupBy("main", "x_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("bx")).withColumn("y_band", F.explode(F.array(*[F.col("x_band") + k for k in (-1, 0, 1)])))
    counts = counts.join(ys.groupBy("main", "y_band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("by")), ["main", "y_band"])
    sets = _sets(texts.join(ys.select("node").distinct(), "node", "left_semi").select("node", "text"), size)
    sets = stored(sets, "crowd-sets")
    keys = ["main", "x_band", "y_band", "xb", "yb"]

    def dealt(rows: DataFrame, band: str, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        rows = rows.join(counts, ["main", band]).withColumn(own, F.pmod(F.xxhash64("node"), F.col(n_own)).cast("int"))
        rows = rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
        return rows.join(sets, "node").select(*[F.col(c).alias(c) for c in (*keys, "node", "shingles")])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        nodes = np.concatenate([x["node"].to_numpy(np.int64), y["node"].to_numpy(np.int64)])
        lists = [np.asarray(v, np.int64) for v in [*x["shingles"], *y["shingles"]]]
        counts = np.array([len(v) for v in lists])
        owner = np.repeat(np.arange(len(lists)), counts)
        ids, column, times = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], (np.cumsum(times > 1) - 1)[column[shared]]
        common = np.zeros((len(x), len(y)), np.float32)
        for start in range(0, int((times > 1).sum()), COLUMNS):
            here = (column >= start) & (column < start + COLUMNS)
            dense = np.zeros((len(lists), COLUMNS), np.float32)
            dense[owner[here], column[here] - start] = 1
            common += dense[: len(x)] @ dense[len(x) :].T
        linked = 100 * common >= percent * (counts[: len(x), None] + counts[None, len(x) :] - common)
        a, b, seen_y = [], [], np.zeros(len(y), bool)
        left = set(range(len(x)))
        while left:  # a spanning forest of the links
            todo = [left.pop()]
            while todo:
                i = todo.pop()
                for j in np.flatnonzero(linked[i] & ~seen_y):
                    seen_y[j] = True
                    a.append(nodes[i])
                    b.append(nodes[len(x) + j])
                    for k in np.flatnonzero(linked[:, j]):
                        if k in left:
                            left.discard(k)
                            todo.append(k)
                            a.append(nodes[k])
                            b.append(nodes[len(x) + j])
        found = pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})
        return found[found["a"] != found["b"]]

    x, y = dealt(xs, "x_band", "xb", "yb", "bx", "by"), dealt(ys, "y_band", "yb", "xb", "by", "bx")
    return x.groupBy(*keys).cogroup(y.groupBy(*keys)).applyInPandas(compare, "a long, b long")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes.

    ``WANTED`` bits, a broadcast of fixed size, keep most other texts from moving;
    those they let pass find no node.
    """
    needed = stored(nodes.select("node", F.col("key").alias("of_key")).join(wanted, "node", "left_semi"), "needed")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(WANTED)) + 1
    bits = needed.select(F.bitmap_bucket_number(place("of_key")).alias("of_bucket"), F.bitmap_bit_position(place("of_key")).alias("bit"))
    bits = bits.repartition("of_bucket").groupBy("of_bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    body = F.coalesce("text", F.lit(""))
    found = docs.select(body.alias("text"), F.unhex(F.md5(body)).alias("key"))
    found = found.withColumns({"bucket": F.bitmap_bucket_number(place("key")), "at": F.bitmap_bit_position(place("key")).cast("int")})
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = found.join(F.broadcast(bits), F.col("bucket") == F.col("of_bucket")).filter(F.getbit(byte, F.col("at") % 8) == 1).select("text", "key")
    found = found.join(needed, F.col("key") == F.col("of_key"))
    return found.groupBy("node").agg(F.first("text").alias("text"))


def deduplicated(
    docs: DataFrame, size: int = 5, percent: int = PERCENT, coordinates: int = COORDINATES, matches: int = MATCHES, shared: int = SHARED, crowd: int = CROWD
) -> DataFrame:
    """The rows of ``docs`` that stay: the first of each component, in order of id (nulls last) and text digest.

    Rows are told apart by a number of their own, not by id: rows of one id with
    different texts are judged each, rows without an id like others, and of
    repeated rows one stays.  Null and blank texts are no copies of anything and
    all stay.  All columns ride along; an empty table gives no rows.
    """
    row, of = fresh("row_number", docs), fresh("of_row", docs)

    def make() -> DataFrame:
        numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")

        def first() -> DataFrame:
            table, classes = _classes(numbered, row, size, percent, coordinates, matches, shared, crowd)
            return classes.select("component_first").union(table.filter("n_shingles = 0").select("row")).withColumnRenamed("component_first", of).distinct()

        stay = settled(docs.sparkSession, "stay", first)  # what it took is gone before whole rows move
        return numbered.join(stay, F.col(row) == F.col(of), "left_semi").select(*docs.columns)

    with measured_broadcasts(docs.sparkSession):
        return settled(docs.sparkSession, "deduplicated", make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, CAST(len(x) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, hash(unnest(x)) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id"""
