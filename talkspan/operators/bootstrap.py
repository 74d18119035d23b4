"""Bootstrap by Poisson weights of a hash: thousands of resamples in one pass over the rows.

The weight of a row in a resample follows from two numbers alone, a hash of the row's id and one of the resample's number,
so every engine that knows the rule gets the same weights and a task that runs again gets the same sums. A task holds, of
each key, arrays with one sum a resample, to which every batch adds a product of values and weights; arrays are merged by
key and range of resamples.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

RESAMPLES = 10_000
#: Weights come from numbers under this prime, whose squares fit 63 bits.
PRIME = 2_147_483_647
#: Resamples in one array of what tasks send.
RANGE = 250
#: Weights held at once inside a task.
CELLS = 1 << 20
SALT = "boot"


def limits(most: int = 7) -> list[int]:
    """A weight is the number of these that a row's number reaches: the distribution of Poisson(1)."""
    out, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        out.append(int(total * PRIME))
    return out


def resample_numbers(n: int) -> np.ndarray:
    """1 .. PRIME - 1 for each resample, by md5 of its number."""
    return np.array([int(hashlib.md5(f"{b}|{SALT}".encode()).hexdigest()[:8], 16) % (PRIME - 1) + 1 for b in range(n)], np.int64)


def weights(row: np.ndarray, resample: np.ndarray) -> np.ndarray:
    """Weights (rows, resamples): x = row * resample mod PRIME, then x * x + row mod PRIME, against the limits."""
    x = row[:, None] * resample[None, :] % PRIME
    x = (x * x + row[:, None]) % PRIME
    return np.searchsorted(np.array(limits()), x, "right").astype(np.float64)


def resampled(rows: DataFrame, keys: list[str], values: list[str], resamples: int = RESAMPLES, id_: str = "id") -> DataFrame:
    """keys, b, weight and the weighted sum of each value, for every key and resample b from 0.

    Rows of one id have one weight in a resample, whatever their key. Rows with a null value are left out; null ids weigh
    alike. Meant for few keys: a task holds (1 + values) * resamples numbers for each that it meets.
    """
    own = rows.where(" and ".join(f"`{v}` is not null" for v in values)).select(
        *keys, *(F.col(v).cast("double").alias(v) for v in values), (T.pick(F.coalesce(F.col(id_).cast("string"), F.lit("")), SALT, PRIME - 1) + 1).alias("_row")
    )
    kinds = ", ".join(f"`{k}` {own.schema[k].dataType.simpleString()}" for k in keys)
    sums = ["weight", *values]
    shape = f"{kinds + ', ' if keys else ''}_part int, {', '.join(f'`{s}` array<double>' for s in sums)}"

    def add_up(batches):
        numbers, held = resample_numbers(resamples), {}
        for b in batches:
            of = b.select(keys).to_pylist() if keys else [{}] * b.num_rows
            place, groups = {}, np.empty(b.num_rows, np.int64)
            for i, k in enumerate(of):
                groups[i] = place.setdefault(tuple(k.values()), len(place))
            row = b.column("_row").to_numpy()
            value = np.stack([np.ones(b.num_rows), *(b.column(v).to_numpy() for v in values)])
            for k, g in place.items():
                mine = np.flatnonzero(groups == g)
                total = held.setdefault(k, np.zeros((len(sums), resamples)))
                step = max(1, CELLS // max(1, len(mine)))
                for i in range(0, resamples, step):
                    total[:, i : i + step] += value[:, mine] @ weights(row[mine], numbers[i : i + step])
        for k, total in held.items():
            parts = range(0, resamples, RANGE)
            columns = {name: [x] * len(parts) for name, x in zip(keys, k)} | {"_part": list(range(len(parts)))}
            columns |= {s: [total[j, i : i + RANGE] for i in parts] for j, s in enumerate(sums)}
            kind = lambda c: types[c] if c in types else pa.int32() if c == "_part" else pa.list_(pa.float64())
            types = {c: b.schema.field(c).type for c in keys}
            yield pa.RecordBatch.from_arrays([pa.array(v, kind(c)) for c, v in columns.items()], list(columns))

    def merge(t: pa.Table) -> pa.Table:
        first = t.slice(0, 1)
        out = [first.column(c) for c in [*keys, "_part"]]
        for s in sums:
            flat = t.column(s).combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
            out.append(pa.array([flat.sum(axis=0)], pa.list_(pa.float64())))
        return pa.Table.from_arrays(out, [*keys, "_part", *sums])

    merged = own.mapInArrow(add_up, shape).groupBy(*keys, "_part").applyInArrow(merge, shape)
    each = merged.select(*keys, "_part", F.posexplode(F.arrays_zip(*sums)).alias("_i", "_s"))  # a row a key and resample
    return each.select(*keys, (F.col("_part") * RANGE + F.col("_i")).alias("b"), *(F.col(f"_s.{s}").alias(s) for s in sums))


def mean_interval(rows: DataFrame, column: str, keys: list[str], resamples: int = RESAMPLES, by_index: bool = False) -> DataFrame:
    """keys, low, mean, high: the 2.5 and 97.5 percentiles of the mean, interpolated or (by_index) sorted[int(q * n)]."""
    own = rows.select(*dict.fromkeys(["id", *keys]), F.col(column).alias("_x"))
    means = resampled(own, keys, ["_x"], resamples).select(*keys, F.try_divide("_x", "weight").alias("m")).where("m is not null")
    if by_index:
        return index_interval(means, keys, "m")
    return means.groupBy(*keys).agg(*(F.round(c, 6).alias(n) for n, c in (("low", F.percentile("m", F.lit(0.025))), ("mean", F.avg("m")), ("high", F.percentile("m", F.lit(0.975))))))


def index_interval(statistics: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, low, mean, high of a statistic with one row a resample: sorted[int(0.025 n)], sorted[int(0.975 n)]."""
    s = statistics.groupBy(*keys).agg(F.array_sort(F.collect_list(column)).alias("s"), F.avg(column).alias("m"))  # one number a resample
    at = lambda q: F.round(F.get("s", F.floor(F.size("s") * q).cast("int")), 6)
    return s.select(*keys, at(0.025).alias("low"), F.round("m", 6).alias("mean"), at(0.975).alias("high"))


def f1_interval(rows: DataFrame, truth, guess, key: str = "maxim", resamples: int = RESAMPLES) -> DataFrame:
    """key, low, mean, high of F1 by key, and of the mean of the keys' F1 in a resample as key macro; rows of one id share
    their weights."""
    own = rows.select("id", key, (truth & guess).cast("int").alias("_tp"), (truth != guess).cast("int").alias("_wrong"))
    sums = resampled(own, [key], ["_tp", "_wrong"], resamples)
    f1 = sums.select(key, "b", F.coalesce(F.try_divide(2 * F.col("_tp"), 2 * F.col("_tp") + F.col("_wrong")), F.lit(0.0)).alias("f1"))
    macro = f1.groupBy("b").agg(F.avg("f1").alias("f1")).select(F.lit("macro").alias(key), "b", "f1")
    return index_interval(f1.unionByName(macro), [key], "f1")
