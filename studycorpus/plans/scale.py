"""Building blocks that keep every operator safe on very uneven keys.

A key may hold a third of all rows. So nothing here orders, numbers or collects
one whole key in one task: first rows come from partial aggregates, numbering
is done per range partition with offsets, and joins salt the heavy keys.
"""
from __future__ import annotations

import contextlib
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

HEAVY_KEYS = 1000          # most keys that are treated as heavy; bounds the broadcast
HEAVY_MIN_ROWS = 10_000    # keys below this never need a salt


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names for checkpoints.

    Only a local session without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: rows are computed once, written as a table and read back.

    A lost executor costs only the running tasks; later steps read the table.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session for what is run inside."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Bucketed:
    """A table in the shared folder whose rows stay hashed by ``keys``, so joins on them move
    only the other side. Rows can be added; ``read`` sees them. The name in the catalog is only
    needed while rows are added: ``close`` drops it, what was read stays readable."""

    def __init__(self, spark: SparkSession, keys: list[str]):
        self.spark, self.keys, self.buckets = spark, keys, shuffle_width(spark)
        self.name = f"table_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"

    def add(self, df: DataFrame, deal: bool = False, **options: str) -> "Bucketed":
        """``deal`` hashes the rows first, so that each bucket is one file; rows that come out of a
        join on the keys lie so already. ``options`` are those of the writer."""
        rows = df.repartition(self.buckets, *self.keys) if deal else df
        rows.write.options(**options).mode("append").bucketBy(self.buckets, *self.keys).option("path", self.path).saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        rows = self.read()
        self.spark.sql(f"drop table {self.name}")
        return rows


def heavy_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with at least ``HEAVY_MIN_ROWS`` rows, the ``HEAVY_KEYS`` largest of them."""
    return (df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") >= HEAVY_MIN_ROWS)
              .orderBy(F.col("_rows").desc()).limit(HEAVY_KEYS).select(*keys))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to ``spark.studycorpus.spread`` tasks, if the session sets it.

    For test tables of one row group, whose scan is a single task. Nothing is
    shuffled without the setting; larger data needs a file layout with enough splits.
    """
    tasks = df.sparkSession.conf.get("spark.studycorpus.spread", None)
    return df.repartition(int(tasks)) if tasks else df


def unused(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that the caller's columns do not have, in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def first_rows(df: DataFrame, keys: list[str], order: list, n: int = 1, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key. The filter on the row number lets Spark keep
    only ``n`` rows per key and map task before the shuffle."""
    name = rank or unused(df.columns, "_rn")[0]
    out = (df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
             .filter(F.col(name) <= n))
    return out if rank else out.drop(name)


def _any_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join many left rows to at most one right row per key.

    Left rows with a null key match nothing; they get a salt of their own, or all
    of them would meet in one task. A heavy key is split by the adaptive skew
    join, which can cut the left side because the right one is a single row.
    """
    row_hash = F.pmod(F.xxhash64(*left.columns), F.lit(shuffle_width(left.sparkSession))).cast("int")
    (salt,) = unused([*left.columns, *right.columns], "_salt")
    lhs = left.withColumn(salt, F.when(_any_null(keys), -1 - row_hash).otherwise(F.lit(0)))
    return lhs.join(right.withColumn(salt, F.lit(0)), [*keys, salt], how).drop(salt)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "left") -> DataFrame:
    """``lookup_join`` for a right side that knows how heavy its keys are.

    ``weight`` names the column with the number of left rows of a key. At most
    ``HEAVY_KEYS`` keys are heavy; only those are broadcast, and their left rows
    are spread over as many salts as there are shuffle tasks.
    """
    salts = shuffle_width(left.sparkSession)
    name, many = unused([*left.columns, *right.columns], "_salt", "_salts")
    heavy = (right.filter(F.col(weight) >= HEAVY_MIN_ROWS)
                  .orderBy(F.col(weight).desc()).limit(HEAVY_KEYS)
                  .select(*keys, F.lit(salts).alias(many)))
    row_hash = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    salt = F.when(_any_null(keys), -1 - row_hash).when(F.col(many).isNull(), F.lit(0)).otherwise(row_hash)
    lhs = left.join(F.broadcast(heavy), keys, "left").withColumn(name, salt).drop(many)
    rhs = (right.join(F.broadcast(heavy), keys, "left")
                .withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(many), F.lit(1)) - 1)))
                .drop(many))
    return lhs.join(rhs, [*keys, name], how).drop(name)


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add running sums (this row included) per key in the given order.

    Rows are range partitioned on (keys, order), summed inside each partition, and
    shifted by the totals of the earlier partitions of the same key: no task sees
    more of a key than its own range. The order must be total.
    """
    width = shuffle_width(df.sparkSession)
    names = list(sums)
    part, *helpers = unused([*df.columns, *names], "_part", *(f"{p}{n}" for p in ("_v_", "_t_", "_o_") for n in names), *(f"_k_{k}" for k in keys))
    value, total, offset = (dict(zip(names, helpers[i * len(names):])) for i in range(3))
    other = dict(zip(keys, helpers[3 * len(names):]))
    base = df
    for n, v in sums.items():
        base = base.withColumn(value[n], v)
    parts = checkpointed(base.repartitionByRange(width, *[F.col(k) for k in keys], *order)
                             .withColumn(part, F.spark_partition_id()))
    inside = W.partitionBy(part, *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = parts
    for n in names:
        local = local.withColumn(n, F.sum(value[n]).over(inside))
    totals = parts.groupBy(part, *keys).agg(*[F.sum(value[n]).alias(total[n]) for n in names])
    before = W.partitionBy(*keys).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    for n in names:
        totals = totals.withColumn(offset[n], F.coalesce(F.sum(total[n]).over(before), F.lit(0)))
    later = totals.filter(reduce(lambda x, y: x | y, [F.col(offset[n]) != 0 for n in names])).select(
        part, *[F.col(k).alias(other[k]) for k in keys], *[offset[n] for n in names])
    # null-safe keys; the offsets hold at most one row per key and partition
    on = [local[part] == later[part]] + [local[k].eqNullSafe(later[other[k]]) for k in keys]
    out = local.join(later, on, "left")
    cols = [local[c] for c in df.columns if c not in names]
    return out.select(*cols, *[(local[n] + F.coalesce(later[offset[n]], F.lit(0))).alias(n) for n in names])


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Row number per key in the given total order, without one task per key."""
    return running(df, keys, order, {name: F.lit(1).cast("long")})


def bucket_sums(df: DataFrame, keys: list[str], position: str, value: Column, name: str,
                width: int = 4096) -> DataFrame:
    """Sum of ``value`` over the earlier positions of a key.

    For integer positions: buckets of ``width`` positions are pre-aggregated, only
    the bucket totals are ordered per key, and the rest happens inside a bucket.
    """
    b, v, t, o, w = unused([*df.columns, name], "_b", "_v", "_t", "_o", "_w")
    rows = df.withColumn(b, F.floor(F.col(position) / width)).withColumn(v, value)
    totals = rows.groupBy(*keys, b).agg(F.sum(v).alias(t))
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, b, F.coalesce(F.sum(t).over(before), F.lit(0)).alias(o))
    inside = W.partitionBy(*keys, b).orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn(w, F.coalesce(F.sum(v).over(inside), F.lit(0)))
                .join(offsets, [*keys, b])
                .withColumn(name, F.col(o) + F.col(w)).drop(b, v, o, w))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges: rows ``(node, component)``.

    ``component`` is the smallest node reachable. Only nodes with an edge are returned.
    Null ends and loops are ignored. Alternating large-star and small-star steps
    (Kiveris et al., 2014): a node's neighbourhood is only ever reduced to its minimum by
    an aggregate and joined back, so a hub is never gathered in one task. Each round is
    written as a table; the number of rounds grows with the logarithm of the longest
    path. ``max_rounds`` only guards against a fault: reaching it raises.
    """
    def tidy(df: DataFrame) -> DataFrame:
        return df.filter("u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()

    links = checkpointed(tidy(edges.selectExpr(f"`{a}` as u", f"`{b}` as v")))
    seen = None
    for _ in range(max_rounds):
        # large star: each larger neighbour of a node moves to the smallest of the neighbourhood
        both = links.unionAll(links.selectExpr("v as u", "u as v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as k", "least(u, m) as m")
        large = both.filter("v > u").join(least, F.col("u") == F.col("k")).selectExpr("v as u", "m as v")
        links = tidy(large)
        # small star: smaller neighbours and the node itself move to the smallest neighbour
        least = links.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u as k", "m")
        small = links.join(least, F.col("u") == F.col("k"))
        links = checkpointed(tidy(small.selectExpr("v as u", "m as v").unionAll(least.selectExpr("k as u", "m as v"))))
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    stars = links.selectExpr("u as node", "v as component")
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
