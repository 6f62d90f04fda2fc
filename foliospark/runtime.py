"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast by :func:`broadcast_if_small`.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    A folder named by ``spark.checkpoint.dir`` or set on the context is kept.  Only a
    local master gets a folder of its own; on a cluster a machine-local folder would be
    lost with its machine, so a missing setting is an error there.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="foliospark-checkpoint-")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged.

    The size is measured, so a table that outgrows the bound falls back to a shuffled
    join instead of filling the driver.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def blank_trim(c: Column) -> Column:
    """``c`` without blanks of any kind at its edges."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def both_sides(rows: DataFrame, key: str, budget: int = 2_000_000) -> DataFrame:
    """Rows of the keys that occur on both sides, with the grid ``_nl`` by ``_nr`` of salts of their key.

    ``rows`` has ``key``, ``id`` and the boolean ``is_left``.  The pairs of a key fall into
    cells of at most about ``budget`` pairs with as many left as right rows, so neither
    side is copied more often than the other side has parts.  Null keys match nothing.
    """
    left, right = F.count_if("is_left"), F.count_if(~F.col("is_left"))
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).agg(left.alias("_l"), right.alias("_r")).where("_l > 0 and _r > 0")
    cells = F.ceil(F.col("_l") * F.col("_r") / budget)
    side = lambda mine, other: F.greatest(F.lit(1), F.least(F.col(mine), F.ceil(F.sqrt(cells * F.col(mine) / F.col(other)))))
    parts = lambda mine, other: F.when(cells <= 1, 1).otherwise(side(mine, other)).cast("int")
    return rows.join(hot.select(key, parts("_l", "_r").alias("_nl"), parts("_r", "_l").alias("_nr")), key)


def salted_pairs(kept: DataFrame, key: str, keep: Column | None = None, columns: tuple[str, ...] = ()) -> DataFrame:
    """``left_id, right_id``: all pairs of a left and a right row of :func:`both_sides` with the same ``key``.

    A left row lies in one row of the key's grid and is repeated for its columns, a right
    row the other way round, so a hot key is worked on by many tasks and every pair still
    meets in one cell only.  ``keep`` tests a pair by the further ``columns``, named
    ``left_...`` and ``right_...``, before it leaves the join.
    """
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("id", *columns)]
    drawn = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = kept.where("is_left").select(key, *named("left"), drawn("_nl").alias("_i"), every("_nr").alias("_j"))
    b = kept.where(~F.col("is_left")).select(key, *named("right"), drawn("_nr").alias("_j"), every("_nl").alias("_i"))
    joined = a.join(b, [key, "_i", "_j"])
    return (joined if keep is None else joined.where(keep)).select("left_id", "right_id")


def pairs_between(rows: DataFrame, key: str, budget: int = 2_000_000) -> DataFrame:
    """``left_id, right_id``: all pairs of a left and a right row with the same ``key``; see :func:`salted_pairs`."""
    return salted_pairs(both_sides(rows, key, budget), key)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for passes that take long per row.

    Input of many partitions, which is the rule at scale, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
