"""Quality rules: word statistics of whole texts, base rules, and robust multivariate outliers.

Per language and source the minimum-covariance-determinant estimate gives a centre and scatter of transformed
statistic vectors; documents at a large Mahalanobis distance go. Groups under MIN_GROUP rows use their language's
estimate, languages under it the one of all rows.

Several starts of each group come from SAMPLE of its rows (by hash, concentrated exactly); each is then concentrated on
all rows of the group until its determinant no longer falls, and the least determinant wins. A step is one pass: rows
are summed by bins of their distance, and the sums of the bins up to the one that holds the h-th distance, which is
taken whole, make the next estimate. Bins are a 64th of a power of two wide, so a group has a few thousand at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, keep_rows, materialize, mix, per_row, raw, row_key, word_spans

SYMBOLS = "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["f_length", "f_word", "f_symbol", "f_line", "f_repeat"]
#: Least standard deviation of each feature; statistics that are constant in a group must not make it infinitely strict.
FLOOR = [0.3, 0.12, 0.5, 0.5, 0.08]
#: Squared distance beyond which a document is an outlier (chi-square of 5 degrees: p of about 6e-8).
CUTOFF = 42.0
SHARE = 0.75
SAMPLE = 400
#: Starts of a group that go on to all rows.
STARTS = 3
MIN_GROUP = 100
MAX_STEPS = 100

_LOOKUP = np.zeros(256, np.uint8)
_LOOKUP[list(SYMBOLS.encode())] = 1


def repeat_words(ids: np.ndarray, row: np.ndarray, rows: int, width: int = 8) -> np.ndarray:
    """Words of each row in a window of width words that the row holds twice or more."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(rows, np.int64)
    h = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step, base = 1, 0xD1342543DE82EF95
    while step < width:
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = base * base % (1 << 64), 2 * step
    h = mix(h + mix(row[:n].astype(np.uint64) + np.uint64(1)))
    inside = np.flatnonzero(row[:n] == row[width - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(h[a] == h[b])
    a, b = a[same], b[same]
    lanes = np.arange(width)
    true = (row[a] == row[b]) & (ids[a[:, None] + lanes] == ids[b[:, None] + lanes]).all(axis=1)
    edge = np.zeros(len(ids) + 1, np.int32)
    marked = np.unique(np.concatenate([a[true], b[true]]))
    edge[marked] += 1
    edge[marked + width] -= 1
    return np.bincount(row[np.cumsum(edge[:-1]) > 0], minlength=rows)


def word_statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns STATS for each text; null counts as empty."""
    data, offs = raw(texts)
    out = {c: np.zeros(len(offs) - 1, np.int64) for c in STATS}
    for i, j in chunks(offs):
        d, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        out["n_symbols"][i:j] = per_row(_LOOKUP[d], o)
        starts, ends, row = word_spans(d, o)
        if not len(starts):
            continue
        out["n_words"][i:j] = np.bincount(row, minlength=j - i)
        solid = np.zeros(len(d) + 1, np.int8)
        np.add.at(solid, starts, 1)
        np.add.at(solid, ends, -1)
        inside = np.cumsum(solid[:-1], dtype=np.int8) > 0
        out["word_chars"][i:j] = per_row(inside & ((d & 0xC0) != 0x80), o)
        size = ends - starts
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32).tobytes()), pa.py_buffer(d[inside].tobytes())])
        ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        out["n_repeat_words"][i:j] = repeat_words(ids, row, j - i)
        body = d.tobytes()
        for k in range(j - i):
            lines = [x for x in body[o[k] : o[k + 1]].split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
            out["n_dup_lines"][i + k] = len(lines) - len(set(lines))
    return out


def row_keys(docs: DataFrame) -> dict:
    """row_key() with lang and source in the hash: all that a verdict depends on."""
    group = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in ("lang", "source") if c in docs.columns]
    return row_key() | {"_hash": F.xxhash64("text", *group)}


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the keys of row_keys() and STATS of every document. Null text: zeros. Missing lang or source columns: null."""
    cols = [F.col(c).cast(t).alias(c) if c in docs.columns else F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("lang", "string"), ("source", "string"), ("text", "string"))]

    def run(batches):
        for b in batches:
            s = word_statistics(b.column(5))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(s[c]) for c in STATS)], ["doc_id", "lang", "source", "_key", "_hash", *STATS])

    keys = [c.alias(k) for k, c in row_keys(docs).items()]
    return docs.select(*cols[:3], *keys, cols[3]).mapInArrow(run, "doc_id long, lang string, source string, _key long, _hash long, " + ", ".join(f"{c} long" for c in STATS))


def base_failed():
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def with_features(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return stats.withColumns(
        {
            "f_length": F.log1p(F.col("n_words").cast("double")),
            "f_word": F.log1p(F.col("word_chars") / n),
            "f_symbol": F.log1p(100.0 * F.col("n_symbols") / n),
            "f_line": F.log1p(F.col("n_dup_lines").cast("double")),
            "f_repeat": F.col("n_repeat_words") / n,
        }
    )


# ---- minimum covariance determinant --------------------------------------------------------------------------


def scatter(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mu = x.mean(axis=0)
    return mu, (x - mu).T @ (x - mu) / max(len(x), 1) + np.diag(np.square(FLOOR))


def distances(x: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> np.ndarray:
    y = x - mu
    return np.einsum("ij,ij->i", y @ np.linalg.inv(cov), y)


def small_mcd(x: np.ndarray, share: float = SHARE, tries: int = 20, keep: int = STARTS, seed: int = 0) -> list[tuple]:
    """(log determinant, centre, scatter) of the best different results of concentration on a bounded sample.

    It goes from several elemental starts and from the whole; results of equal determinant (to 1e-6) count as one.
    """
    h, p = max(1, int(share * len(x))), x.shape[1]
    rng, out = np.random.default_rng(seed), []
    for k in range(tries + 1):
        mu, cov = scatter(x if not k or len(x) <= p + 1 else x[rng.choice(len(x), p + 1, replace=False)])
        for _ in range(20):
            near = np.argsort(distances(x, mu, cov), kind="stable")[:h]
            new = scatter(x[near])
            done = np.allclose(new[0], mu) and np.allclose(new[1], cov)
            mu, cov = new
            if done:
                break
        det = np.linalg.slogdet(cov)[1]
        if all(abs(det - d) > 1e-6 for d, _, _ in out):
            out.append((det, mu, cov))
    return sorted(out, key=lambda r: r[0])[:keep]


def _distance_column(mu: str = "mu", inv: str = "inv"):
    y = [F.col(f) - F.get(F.col(mu), i) for i, f in enumerate(FEATURES)]
    p = len(FEATURES)
    return sum((y[i] * y[j] * F.get(F.col(inv), i * p + j) for i in range(p) for j in range(p)), F.lit(0.0))


def distance_bin(d):
    """A 64th of a power of two; all distances under 2**-20 are one bin."""
    return F.floor(F.log2(F.greatest(d, F.lit(2.0**-20))) * 64).cast("int")


_ESTIMATE = "grp string, start int, det double, mu array<double>, inv array<double>, open boolean"


def _estimate_row(group: str, start: int, det: float, mu: np.ndarray, cov: np.ndarray) -> list:
    return [group, start, float(det), mu.tolist(), np.linalg.inv(cov).ravel().tolist(), True]


def estimates(rows: DataFrame) -> DataFrame:
    """grp, mu, inv of every group (column grp) of rows with FEATURES and a column _order that deals out the sample.

    Each step writes the estimates (STARTS rows a group) and reads all rows once. A start is settled when a step no
    longer lowers its determinant; more than MAX_STEPS steps are an error.
    """
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    rank = F.row_number().over(Window.partitionBy("grp").orderBy("_order", *FEATURES))
    sample = rows.select("grp", "_order", *FEATURES).withColumn("_rank", rank).where(F.col("_rank") <= SAMPLE)

    def begin(pdf):
        import pandas as pd

        x = pdf.sort_values("_rank")[FEATURES].to_numpy(float)
        own = [_estimate_row(pdf["grp"].iloc[0], k, np.inf, mu, cov) for k, (_, mu, cov) in enumerate(small_mcd(x))]
        return pd.DataFrame(own, columns=["grp", "start", "det", "mu", "inv", "open"])

    def step(bins, now):
        import pandas as pd

        old = now.iloc[0]
        bins = bins.sort_values("bin")
        n = bins["n"].to_numpy()
        h = max(1, int(SHARE * n.sum()))
        upto = int(np.searchsorted(np.cumsum(n), h)) + 1
        total = bins.iloc[:upto][["n", *(f"s{i}" for i in range(p)), *(f"q{i}_{j}" for i, j in pairs)]].sum()
        mu = np.array([total[f"s{i}"] for i in range(p)]) / total["n"]
        cov = np.array([[total[f"q{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / total["n"] - np.outer(mu, mu) + np.diag(np.square(FLOOR))
        det = np.linalg.slogdet(cov)[1]
        row = _estimate_row(old["grp"], int(old["start"]), det, mu, cov)
        if not det < old["det"] - 1e-9:
            row = [*old[["grp", "start", "det", "mu", "inv"]], False]
        return pd.DataFrame([row], columns=["grp", "start", "det", "mu", "inv", "open"])

    sums = [F.count("*").alias("n"), *(F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)), *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"q{i}_{j}") for i, j in pairs)]
    slim = rows.select("grp", *FEATURES)
    now = materialize(sample.groupBy("grp").applyInPandas(begin, _ESTIMATE), "start")
    settled = []
    for _ in range(MAX_STEPS):
        if now.isEmpty():
            break
        # `now` was written, so its size lets Spark broadcast it: rows of a hot group are not dealt to one task
        bins = slim.join(now.select("grp", "start", "mu", "inv"), "grp").withColumn("bin", distance_bin(_distance_column())).groupBy("grp", "start", "bin").agg(*sums)
        again = now.select(*(F.col(c).alias(c) for c in now.columns))  # names of its own beside those in bins
        after = materialize(bins.groupBy("grp", "start").cogroup(again.groupBy("grp", "start")).applyInPandas(step, _ESTIMATE), "estimate")
        settled.append(after.where("not open"))
        now = after.where("open")
    else:
        raise RuntimeError(f"estimates not settled after {MAX_STEPS} steps")
    every = now
    for part in settled:
        every = every.unionByName(part)
    best = every.groupBy("grp").agg(F.min_by(F.struct("mu", "inv"), F.struct("det", "start")).alias("e"))
    return materialize(best.select("grp", "e.mu", "e.inv"), "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, STATS, base_failed, distance, kept.

    kept is false if base_failed or if the squared Mahalanobis distance is over CUTOFF. Null lang or source form
    groups of their own. Null doc_ids and repeated rows are judged like any other. With too few rows for any estimate
    no document is an outlier and distance is null. Empty table: empty result. Extra columns are not read.
    """
    return verdicts(docs).drop("_key", "_hash")


def verdicts(docs: DataFrame, least: int | None = None) -> DataFrame:
    """What judge() gives, with the keys of row_keys(). least: rows that a group must have for an estimate of its own.

    The statistics and the estimates are written while this is called.
    """
    least = MIN_GROUP if least is None else least
    own = with_features(document_statistics(docs)).withColumns({"lang": F.coalesce("lang", F.lit("\x00")), "source": F.coalesce("source", F.lit("\x00")), "base_failed": base_failed()})
    rows = materialize(own, "statistics")
    fit = rows.where(~F.col("base_failed"))
    # one row a language and source: the smallest group around it that has enough rows
    sizes = fit.groupBy("lang", "source").agg(F.count("*").alias("n0"))
    by_lang, every = sizes.groupBy("lang").agg(F.sum("n0").alias("n1")), sizes.agg(F.sum("n0").alias("n2"))
    name = F.when(F.col("n0") >= least, F.concat(F.lit("source:"), "lang", F.lit("\x01"), "source")).when(F.col("n1") >= least, F.concat(F.lit("language:"), "lang")).when(F.col("n2") >= least, F.lit("all"))
    groups = materialize(sizes.join(by_lang, "lang").crossJoin(every).select("lang", "source", name.alias("grp")).where("grp is not null"), "groups")
    # the rows of a group are those it is named after, whoever else uses it
    wide = groups.select("grp").distinct()
    levels = [F.concat(F.lit("source:"), "lang", F.lit("\x01"), "source"), F.concat(F.lit("language:"), "lang"), F.lit("all")]
    order = F.xxhash64("doc_id", *STATS).alias("_order")
    members = fit.select(F.explode(F.array(*levels)).alias("grp"), order, *FEATURES).join(wide, "grp", "left_semi")
    found = estimates(materialize(members, "members"))
    out = rows.join(groups, ["lang", "source"], "left").join(found, "grp", "left").withColumn("distance", _distance_column())
    kept = ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= CUTOFF)
    return out.select("doc_id", "_key", "_hash", *STATS, "base_failed", "distance", kept.alias("kept"))


def drop_low_quality(docs: DataFrame) -> DataFrame:
    """The documents (all columns) that judge() keeps, each row by its own id, text, lang and source."""
    kept = verdicts(docs).where("kept").select("_key", "_hash").distinct()
    return keep_rows(docs, row_keys(docs), kept)
