"""Mixing of sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from capture_spark.llm.tables import fresh, positions, settled, stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
MADE = ("size", "source_size", "target", "copies")
TIE = "mix_tie"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, n_docs, target) from one row (source, source_size, n_docs) per source.

    A source's target is the smaller of ``most`` times its size and its weight
    times one level; the level that makes the targets add up to all sizes is
    where, with the sources in order of size over weight, the capped ones are a
    prefix.  The windows run over the aggregated sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long")
    t = sizes.withColumn("weight", weight).withColumns(
        {
            "rest": F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
            "rest_weight": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "place": F.row_number().over(by_cap),
        }
    )
    capped = most * F.col("source_size") * F.col("rest_weight") <= F.col("rest") * F.col("weight")
    t = t.withColumn("first_free", F.min(F.when(~capped, F.col("place"))).over(whole))
    t = t.withColumns({c: F.max(F.when(F.col("place") == F.col("first_free"), F.col(c))).over(whole) for c in ("rest", "rest_weight")})
    free = F.col("place") >= F.col("first_free")
    target = F.when(free, (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double")).otherwise((most * F.col("source_size")).cast("double"))
    return t.select("source", "source_size", "n_docs", target.alias("target"))


def sized(docs: DataFrame, text: str = "text") -> DataFrame:
    """Put the number of words of each text into ``size``; null has none.  ``mix_tie`` is a digest of the row, by which rows of one id keep their order when the text has gone."""
    own = [f.name for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant", "interval") and f.name not in (*MADE, TIE)]
    return docs.drop(*MADE, TIE).withColumns({"size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"), TIE: F.xxhash64(*[F.col(f"`{c}`") for c in own])})


def mix_sized(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "0") -> DataFrame:
    """Add ``source_size``, ``target`` and ``copies`` to rows with doc_id, source and size.

    Each row of a source expects target / source_size copies.  The rows stand in
    order of size (ties by a digest of ``doc_id``, then by ``mix_tie``, see ``sized``), so that the running sum passes
    evenly through short and long texts; one offset from a digest of the source
    is added, and a row gets a copy for each integer that the sum crosses in it.
    So copies differ by one at most within a source, and reruns agree.  The
    running sum comes from ``positions``, by which a large source spreads over
    many tasks.  A null source is a source of its own, last in order; texts of
    size 0 get copies like others, but take no words.  Columns with these names
    are replaced, others ride along; repeated rows count each.
    """
    sized = docs.drop(*MADE[1:])
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    mark = fresh("mix_digest", sized)
    placed = positions(sized.withColumn(mark, digest), ["source"], ["size", mark, *([TIE] if TIE in sized.columns else [])], "mix")
    of = fresh("of_source", placed)
    totals = placed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = source_targets(totals, weights, most).select(F.col("source").alias(of), "source_size", "target")
    rate = placed.join(targets, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce("source", F.lit("\0")))), 1, 12), 16, 10).cast("double") / float(16**12)

    def crossed(rows):
        return F.when(F.col("source_size") > 0, F.floor(F.col("target") * rows.cast("double") / F.col("source_size").cast("double") + start)).otherwise(rows)

    return rate.withColumn("copies", (crossed(F.col("position") + 1) - crossed(F.col("position"))).cast("int")).select(*[c for c in sized.columns if c != TIE], *MADE[1:])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns.

    Nulls, repeated rows and columns of any name are allowed, as in ``mix_sized``;
    an empty table gives no rows.
    """
    clear = {c: fresh(f"own_{c}", docs) for c in (*MADE, TIE, "position") if c in docs.columns}
    renamed = docs.withColumnsRenamed(clear)

    def make() -> DataFrame:
        taken = mix_sized(stored(sized(renamed), "sized"), **options)
        return taken.withColumn(fresh("mix_copy", taken), F.explode(F.expr("CASE WHEN copies > 0 THEN sequence(1, copies) ELSE array() END"))).select(*renamed.columns)

    return settled(docs.sparkSession, "mixed", make).withColumnsRenamed({to: c for c, to in clear.items()}).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    out = mix_sized(sized(docs).drop("text"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
t1 AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight FROM t0),
t2 AS (SELECT *, row_number() OVER o AS place,
  CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest,
  CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rest_weight
  FROM t1 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
t3 AS (SELECT *, min(CASE WHEN 3 * source_size * rest_weight > rest * weight THEN place END) OVER () AS first_free FROM t2),
t4 AS (SELECT *, max(CASE WHEN place = first_free THEN rest END) OVER () AS r, max(CASE WHEN place = first_free THEN rest_weight END) OVER () AS rw FROM t3),
t AS (SELECT source, source_size, CASE WHEN place >= first_free THEN CAST(weight * r AS DOUBLE) / CAST(rw AS DOUBLE) ELSE CAST(3 * source_size AS DOUBLE) END AS target,
  CAST(CAST('0x' || substr(md5('0|' || coalesce(source, chr(0))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0::DOUBLE AS start FROM t4),
p AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.start, row_number() OVER (PARTITION BY s.source ORDER BY s.size, md5('0|' || CAST(s.doc_id AS VARCHAR))) AS n
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size > 0 THEN size * (floor(target * CAST(n AS DOUBLE) / CAST(source_size AS DOUBLE) + start) - floor(target * CAST(n - 1 AS DOUBLE) / CAST(source_size AS DOUBLE) + start)) ELSE 0 END AS BIGINT) AS taken
FROM p"""
