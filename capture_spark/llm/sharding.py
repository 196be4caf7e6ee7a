"""Shards that balance bytes, tokens and rows jointly (vector bin packing)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm.mixing import WORD
from capture_spark.llm.tables import positions, stored

SHARDS = 16
HEAVY = 1024
GROUPS_PER_PART = 8192
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows), given what each shard has room for.

    Items go in order of their largest share of any total, each to the shard
    where the dot product of item and residual capacity is highest, both as
    shares of a shard's mean capacity.  Bytes are the law, so a shard that an
    item would overfill in bytes is taken only if every shard would be, and then
    the one with most bytes free.
    """
    unit = np.maximum(capacity.mean(0), 1e-9)
    size, left = items / unit, capacity / unit
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -size.max(1))) if len(items) else ():
        fits = left[:, 0] >= size[i, 0]
        out[i] = np.argmax(np.where(fits, left @ size[i], -np.inf) if fits.any() else left[:, 0])
        left[out[i]] -= size[i]
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, heavy: int = HEAVY, per_part: int = GROUPS_PER_PART) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of ``docs``.

    Equal texts make a group, and a group stays in one shard unless it has more
    bytes than half a shard: then it is cut into pieces of about 1/(4 shards) of
    all bytes, with as many rows each as can be.  Groups with over 1/``heavy`` of
    all bytes, tokens or rows, of which there are three times ``heavy`` at most,
    are packed first, by the driver.  The others are dealt by digest into parts of
    about ``per_part`` groups; a task packs the groups of a part one by one, into
    its part of the room that is left in each shard, so the shards' sums differ by
    about one of the smallest groups a part.  The driver holds heavy groups and
    ``shards`` vectors, whatever the input.  The law is ``bytes``.  Slots count
    from 0 in each shard, by text digest and id.  Null texts are the empty text;
    null ids, repeated rows, very long texts and extra columns are allowed, ties
    go by text digest; an empty table gives no rows.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.regexp_count(body, F.lit(WORD)).cast("long").alias("tokens"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.md5(body)).alias("group"),
    )
    rows = stored(rows, "shard-rows")
    sums = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = stored(rows.groupBy("group").agg(*sums), "shard-groups")
    whole = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMENSIONS], F.count("*").alias("groups")).first()
    total = np.array([whole[c] for c in DIMENSIONS], float)
    is_heavy = F.lit(False)
    for c in DIMENSIONS:
        is_heavy = is_heavy | (F.col(c) * heavy > F.lit(whole[c]))
    large = groups.filter(is_heavy).orderBy("group").collect()  # 3 heavy at most

    items, names = [], []
    for r in large:
        cut = 1 if r["bytes"] * 2 * shards <= total[0] else min(-(-r["bytes"] * 4 * shards // int(total[0])), r["rows"])
        for k in range(cut):
            own = r["rows"] // cut + (k < r["rows"] % cut)
            items.append([r["bytes"] / r["rows"] * own, r["tokens"] / r["rows"] * own, own])
            names.append(bytes(r["group"]))
    vectors = np.array(items, float).reshape(-1, len(DIMENSIONS))
    capacity = np.tile(total / shards, (shards, 1))
    places = pack(vectors, capacity)
    room = capacity.copy()
    np.subtract.at(room, places, vectors)
    room = np.maximum(room, 0)
    share = room / np.maximum(room.sum(0), 1e-9)  # of each shard in what the other groups need
    of_group: dict[bytes, list[int]] = {}
    for n, p in zip(names, places, strict=True):
        of_group.setdefault(n, []).append(int(p))
    pieces = spark.createDataFrame(list(of_group.items()), "group binary, piece_shards array<int>")

    def packed(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("group", ignore_index=True)
        own = part[list(DIMENSIONS)].to_numpy(float)
        return pd.DataFrame({"group": part["group"], "shard": pack(own, share * own.sum(0)).astype(np.int32)})

    parts = max(1, -(-whole["groups"] // per_part))
    light = groups.filter(~is_heavy).withColumn("part", F.pmod(F.xxhash64("group"), F.lit(parts)))
    light = stored(light.groupBy("part").applyInPandas(packed, "group binary, shard int"), "packed")

    few = rows.join(F.broadcast(pieces), "group")
    few = positions(few, ["group"], ["doc_id"], "pieces").withColumn("shard", F.get("piece_shards", F.pmod("position", F.size("piece_shards")).cast("int")))
    columns = ["doc_id", "size", "text_crc32", "group", "shard"]
    dealt = rows.join(F.broadcast(pieces.select("group")), "group", "left_anti").join(light, "group").select(*columns).unionByName(few.select(*columns))
    numbered = positions(dealt, ["shard"], ["group", "doc_id"], "shard-slots")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
