"""Samples, splits, caps and dedup in the repeatable order of md5(id|salt)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import PARTS, cut


def order_key(column: str, salt: str):
    return F.md5(F.concat(F.col(column).cast("string"), F.lit("|" + salt)))


def per_group(rows: DataFrame, keys: list[str], cap: int, id_: str, salt: str) -> DataFrame:
    """At most cap rows of each group; the group limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order_key(id_, salt), F.col(id_))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def stratified_split(rows: DataFrame, keys: list[str], id_: str, salt: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Column split: the first int(train * n) of each stratum are train, the next int(val * n) val, the rest test.

    Without keys all rows are one stratum. No task sorts a stratum whole, see ranked().
    """
    k, n = F.col("_k"), F.col("_n")
    split = F.when(k <= F.floor(n * train), "train").when(k <= F.floor(n * train) + F.floor(n * val), "val").otherwise("test")
    return ranked(rows, keys, id_, salt).withColumn("split", split).drop("_k", "_n")


def hashed_split(column: str, salt: str, train: int = 80, val: int = 10):
    """A split by hash share alone: no window, no shuffle; the way for large inputs."""
    u = F.conv(F.substring(order_key(column, salt), 1, 8), 16, 10).cast("long") % 100
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def keep_first(rows: DataFrame, key, id_: str) -> DataFrame:
    """The row with the smallest id of each key, by an aggregate that combines before the shuffle."""
    cols = [F.col(c) for c in rows.columns]
    return rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cols), F.col(id_)).alias("r")).select("r.*")


def every_nth(rows: DataFrame, keys: list[str], id_: str, cap: int) -> DataFrame:
    """Groups over cap rows keep each (n // cap)-th row by id, cap at most."""
    r = placed(rows, keys, F.col(id_), id_)
    step = F.greatest(F.floor(F.col("_n") / cap), F.lit(1))
    k = F.col("_k") - 1
    return r.where((F.col("_n") <= cap) | ((k % step == 0) & (k / step < cap))).drop("_k", "_n")


def oversample(rows: DataFrame, times: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def ranked(rows: DataFrame, keys: list[str], id_: str, salt: str) -> DataFrame:
    """Columns _k (from 1) and _n: place of each row in its group's md5 order, and the group's size.

    Ranks of hash prefixes come first, then places inside a prefix, so a hot group is sorted by up to 4096 tasks.
    """
    r = rows.withColumn("_h", order_key(id_, salt)).withColumn("_p", F.substring("_h", 1, 3))
    return _places(r, keys, "_h", id_)


def placed(rows: DataFrame, keys: list[str], by, id_: str, parts: int = PARTS) -> DataFrame:
    """As ranked(), in the order of a number `by`, which is cut into ranges of about equal counts."""
    own = rows.withColumn("_h", by)
    return _places(cut(own, F.col("_h"), parts=parts), keys, "_h", id_)


def _places(r: DataFrame, keys: list[str], order: str, id_: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    sizes = r.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))  # at most 4097 rows a group
    sizes = sizes.select(*keys, "_p", (F.sum("_c").over(w.orderBy("_p")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    k = F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(order, id_))
    on = r["_p"].eqNullSafe(sizes["_p"])
    for c in keys:
        on = on & r[c].eqNullSafe(sizes[c])
    joined = r.join(sizes, on).drop(*(sizes[c] for c in (*keys, "_p")))
    return joined.withColumn("_k", k).drop("_h", "_p", "_before")


def holdout(rows: DataFrame, keys: list[str], percent: int, id_: str, salt: str) -> DataFrame:
    """Column held_out: percent of each group, rounded down, one row at least."""
    r = ranked(rows, keys, id_, salt)
    return r.withColumn("held_out", F.col("_k") <= F.greatest(F.floor(F.col("_n") * percent / 100), F.lit(1))).drop("_k", "_n")


def balance_to_ratio(rows: DataFrame, key: str, percents: dict[str, int], id_: str, salt: str) -> DataFrame:
    """The largest sample whose groups have the given shares; groups without a share go. Equal shares: the least size."""
    share = F.create_map(*(F.lit(x) for kv in percents.items() for x in kv))[F.col(key)]
    own = rows.where(F.col(key).isin(*percents))
    total = F.min(F.floor(F.col("_c") * 100 / share)).over(Window.partitionBy())  # over one row a group
    caps = own.groupBy(key).agg(F.count("*").alias("_c")).select(key, F.floor(total * share / 100).alias("_take"))
    return ranked(own, [key], id_, salt).join(caps, key).where(F.col("_k") <= F.col("_take")).drop("_k", "_n", "_take")


def quota_sample(rows: DataFrame, wants: list, id_: str, salt: str) -> DataFrame:
    """wants: (category, condition, quota) in turn; each takes the first of its rows, in md5 order, that none before took.

    What earlier categories took has at most the sum of their quotas as rows, so it is broadcast.
    """
    taken, out = None, None
    for k, (category, condition, quota) in enumerate(wants):
        own = rows.where(condition)
        if taken is not None:
            own = own.join(F.broadcast(taken), id_, "left_anti")
        own = own.orderBy(order_key(id_, f"{salt}{k}"), id_).limit(quota).withColumn("category", F.lit(category))
        taken = own.select(id_) if taken is None else taken.unionByName(own.select(id_))
        out = own if out is None else out.unionByName(own)
    return out
