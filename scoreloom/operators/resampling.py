"""Bootstraps and regressions from sums that add up.

Fits need a group's rows only as sums of products. A resample is a weight for
each row, so it needs the same sums with weights. Equal rows are counted, a
group's distinct rows are dealt by hash to chunks of some CHUNK, and each chunk is
drawn from on its own, as often as it has rows (with one chunk that is the plain
bootstrap; with many the strata take a thousandth off the variance at most). A
chunk's draws are seeded by the group's key and the chunk's number alone, so a
lost task draws the same again. Sums of chunks are added in the task, then by
Spark: a task holds one chunk and one set of sums, however large the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, TIMES, SEED = 1024, 2000, 2025
#: Share of a variable's variance, and of the largest eigenvalue, under which there is none.
NO_SHARE, NO_RANK = 1e-12, 1e-10
_PLAIN = -1


def identity(by: list[str]) -> Column:
    """A text that tells groups apart, null ones too."""
    return F.to_json(F.struct(*by), {"ignoreNullFields": "false"})


def weights(counts: np.ndarray, rng: np.random.Generator, times: int) -> np.ndarray:
    """How often each row is drawn in each resample; counts: how often the row is there."""
    n, d = int(counts.sum()), len(counts)
    if n > 8 * CHUNK:
        return rng.multinomial(n, counts / n, times).astype(float)
    drawn = np.repeat(np.arange(d), counts)[rng.integers(0, n, (times, n))]
    return np.bincount((drawn + np.arange(times)[:, None] * d).ravel(), minlength=times * d).reshape(times, d).astype(float)


def moments(rows: DataFrame, columns: list[str], by: list[str], times: int = TIMES, order: list[str] | None = None, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """id_, resample, m0, m1 ...: sums of products of one and the columns less the group's means, for each resample and (-1) for the rows themselves;
    and for each group id_, the columns of `by`, n_ and the means. Rows with a null in a column are left out.

    order: columns that a chunk's rows are sorted by before they are drawn (else the columns).
    """
    pairs = list(combinations_with_replacement(range(len(columns) + 1), 2))
    names = [f"m{i}" for i in range(len(pairs))]
    wide = list(dict.fromkeys([*(order or []), *columns]))
    good = rows.where(" and ".join(f"`{c}` is not null" for c in columns)).select(*by, *[F.col(c).cast("double").alias(c) for c in wide])
    counted = good.groupBy(identity(by).alias("id_"), F.concat_ws("|", *by).alias("key_"), *wide).agg(F.count(F.lit(1)).alias("n_"), *[F.any_value(c).alias(f"by_{i}") for i, c in enumerate(by)])
    means = [(F.sum(F.col(c) * F.col("n_")) / F.sum("n_")).alias(f"mean_{i}") for i, c in enumerate(columns)]
    groups = counted.groupBy("id_").agg(F.sum("n_").alias("all_"), F.count(F.lit(1)).alias("distinct_"), *[F.any_value(f"by_{i}").alias(f"by_{i}") for i in range(len(by))], *means)
    dealt = counted.drop(*[f"by_{i}" for i in range(len(by))]).join(groups, "id_")
    dealt = dealt.withColumn("chunks_", F.ceil(F.col("distinct_") / chunk)).withColumn("chunk_", F.pmod(F.xxhash64(*wide), F.col("chunks_")))
    dealt = dealt.select("id_", "key_", "chunk_", "n_", *wide, *[f"mean_{i}" for i in range(len(columns))])

    def sums(t: pd.DataFrame) -> np.ndarray:
        v = np.column_stack([np.ones(len(t)), *(t[c].to_numpy(float) - t[f"mean_{i}"].to_numpy(float) for i, c in enumerate(columns))])
        product = np.column_stack([v[:, i] * v[:, j] for i, j in pairs])
        counts, number = t["n_"].to_numpy(), int(t["chunk_"].iloc[0])
        rng = np.random.default_rng([SEED, crc32(t["key_"].iloc[0].encode())] + ([number] if number else []))
        return np.concatenate([weights(counts, rng, times) @ product, counts[None, :] @ product])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, of = [], None, None

        def sent() -> pa.RecordBatch:
            resample = np.append(np.arange(times), _PLAIN).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([of] * len(resample)), pa.array(resample), *map(pa.array, total.T.copy())], ["id_", "resample", *names])

        def chunks() -> Iterator[pd.DataFrame]:
            for batch in batches:
                t = batch.to_pandas()
                if not len(t):
                    continue
                new = ((t["id_"] != t["id_"].shift()) | (t["chunk_"] != t["chunk_"].shift())).cumsum()
                for _, part in t.groupby(new):
                    if held and (held[-1]["id_"].iloc[0], held[-1]["chunk_"].iloc[0]) != (part["id_"].iloc[0], part["chunk_"].iloc[0]):
                        yield pd.concat(held)
                        held.clear()
                    held.append(part)
            if held:
                yield pd.concat(held)

        for t in chunks():
            if of is not None and t["id_"].iloc[0] != of:
                yield sent()
                total = None
            of = t["id_"].iloc[0]
            total = sums(t) if total is None else total + sums(t)
        if of is not None:
            yield sent()

    placed = dealt.repartition("id_", "chunk_").sortWithinPartitions("id_", "chunk_", *wide)
    drawn = placed.mapInArrow(run, "id_ string, resample int, " + ", ".join(f"{n} double" for n in names))
    added = drawn.groupBy("id_", "resample").agg(*[F.sum(n).alias(n) for n in names])
    return added, groups.select("id_", *[F.col(f"by_{i}").alias(c) for i, c in enumerate(by)], F.col("all_").alias("n_"), *[f"mean_{i}" for i in range(len(columns))])


def _cut(value: Column, share: float) -> Column:
    return F.percentile(value, F.lit(share))


def of_two(rows: DataFrame, kind: str, x: str, y: str, by: list[str], times: int = TIMES) -> DataFrame:
    """The columns of `by`, value, low, high, n: correlation (r) or slope of y on x with its 95 % percentile interval; NaN without spread or under three rows (two for a slope)."""
    added, _ = moments(rows, [x, y], by, times)
    n, mx, my = F.col("m0"), F.col("m1") / F.col("m0"), F.col("m2") / F.col("m0")
    xx, xy, yy = F.col("m3") / n - mx * mx, F.col("m4") / n - mx * my, F.col("m5") / n - my * my
    stats = added.select("id_", "resample", n.alias("n_"), xx.alias("xx"), xy.alias("xy"), yy.alias("yy"))
    plain = stats.where(F.col("resample") == _PLAIN).select("id_", F.col("n_").alias("all_"), F.col("xx").alias("xx_"), F.col("xy").alias("xy_"), F.col("yy").alias("yy_"))
    statistic = lambda a, b, c: F.col(b) / (F.sqrt(F.col(a) * F.col(c)) if kind == "r" else F.col(a))
    some = (F.col("all_") >= (3 if kind == "r" else 2)) & (F.col("xx_") > 0) & (F.col("yy_") > 0)
    spread = (F.col("xx") > NO_SHARE * F.col("xx_")) & (F.col("yy") > NO_SHARE * F.col("yy_"))
    each = stats.join(plain, "id_").where(some & spread).withColumn("s_", statistic("xx", "xy", "yy"))
    own = F.when(F.col("resample") == _PLAIN, F.col("s_"))
    other = F.when(F.col("resample") != _PLAIN, F.col("s_"))
    # at most `times` values a group
    cut = each.groupBy("id_").agg(F.max(own).alias("value"), _cut(other, 0.025).alias("low"), _cut(other, 0.975).alias("high"))
    whole = rows.groupBy(identity(by).alias("id_")).agg(*[F.any_value(c).alias(c) for c in by], F.count(F.lit(1)).alias("n"))
    nan = lambda c: F.coalesce(c, F.lit(float("nan"))).alias(c)
    return whole.join(cut, "id_", "left").select(*by, nan("value"), nan("low"), nan("high"), "n")


def solved(gram: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (intercept first) of least squares, and R squared (0 without spread of y), from sums of products.

    gram: many symmetric matrices of sums of one, y and the terms, less centre.
    Of several solutions the one of least norm is given.
    """
    n = gram[:, 0, 0]
    mean = gram[:, 0, 1:] / n[:, None]
    cov = gram[:, 1:, 1:] / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    size = np.sqrt(np.maximum(np.einsum("bii->bi", cov), 0))
    floor = np.sqrt(NO_SHARE) * np.sqrt(np.maximum(np.einsum("bii->bi", gram)[:, 1:] / n[:, None], 1e-300))
    flat = size <= floor
    scale = np.where(flat, 1.0, size)
    cor = np.where(flat[:, :, None] | flat[:, None, :], 0.0, cov / (scale[:, :, None] * scale[:, None, :]))
    value, vector = np.linalg.eigh(cor[:, 1:, 1:])
    good = value > NO_RANK * np.maximum(value.max(axis=1, keepdims=True, initial=0), 1e-300)
    turned = np.einsum("bij,bi->bj", vector, cor[:, 1:, 0])
    slope = np.einsum("bij,bj->bi", vector, np.where(good, turned / np.where(good, value, 1), 0)) * scale[:, :1] / scale[:, 1:]
    at = mean + centre
    coef = np.concatenate([(at[:, 0] - (slope * at[:, 1:]).sum(axis=1))[:, None], slope], axis=1)
    rest = cov[:, 0, 0] - 2 * (slope * cov[:, 1:, 0]).sum(axis=1) + np.einsum("bi,bij,bj->b", slope, cov[:, 1:, 1:], slope)
    r2 = np.where(flat[:, 0], 0.0, 1 - rest / np.where(flat[:, 0], 1, cov[:, 0, 0]))
    for b in np.flatnonzero(~good.all(axis=1)):
        # directions that change no fitted value: take the solution's part along them away
        free = vector[b][:, ~good[b]] / scale[b, 1:, None]
        base, _ = np.linalg.qr(np.concatenate([-(at[b, 1:] @ free)[None], free]))
        coef[b] -= base @ (base.T @ coef[b])
    return coef, r2


def fits(rows: DataFrame, y: str, terms: list[str], by: list[str], times: int = TIMES, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """id_, resample, coef (intercept first), r2 of y on the terms for each resample and (-1) the rows themselves; and the groups, of more rows than terms."""
    added, groups = moments(rows, [y, *terms], by, times, order)
    groups = groups.where(F.col("n_") >= len(terms) + 1)
    k = len(terms) + 2
    names = [f"m{i}" for i in range(k * (k + 1) // 2)]
    means = [f"mean_{i}" for i in range(k - 1)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            gram = np.zeros((len(t), k, k))
            for n, (i, j) in zip(names, combinations_with_replacement(range(k), 2)):
                gram[:, i, j] = gram[:, j, i] = t[n]
            coef, r2 = solved(gram, t[means].to_numpy(float))
            yield pd.DataFrame({"id_": t["id_"], "resample": t["resample"], "coef": list(coef), "r2": r2})

    return added.join(groups.select("id_", *means), "id_").mapInPandas(run, "id_ string, resample int, coef array<double>, r2 double"), groups


def of_terms(rows: DataFrame, y: str, terms: list[str], by: list[str], times: int = TIMES, order: list[str] | None = None) -> DataFrame:
    """The columns of `by`, r2, and for the intercept and each term (c0, c1, ...) value, low, high: a struct each."""
    each, groups = fits(rows, y, terms, by, times, order)
    plain = F.col("resample") == _PLAIN
    part = lambda i: F.struct(F.max(F.when(plain, F.col("coef")[i])).alias("value"), _cut(F.when(~plain, F.col("coef")[i]), 0.025).alias("low"), _cut(F.when(~plain, F.col("coef")[i]), 0.975).alias("high"))
    found = each.groupBy("id_").agg(F.max(F.when(plain, F.col("r2"))).alias("r2"), *[part(i).alias(f"c{i}") for i in range(len(terms) + 1)])
    return groups.select("id_", *by).join(found, "id_").drop("id_")


def residuals(rows: DataFrame, y: str, terms: list[str], by: str, key: list[str]) -> DataFrame:
    """by, key, residual of y on the terms within each group; less its mean where rows are no more than terms.

    Means and covariances are aggregates with partial sums; a group's coefficients are solved from one row.
    """
    good = rows.where(" and ".join(f"`{c}` is not null" for c in (y, *terms)))
    columns = [y, *terms]
    pairs = list(combinations_with_replacement(range(len(columns)), 2))
    parts = [F.avg(F.col(c).cast("double")).alias(f"mean_{i}") for i, c in enumerate(columns)] + [F.covar_pop(F.col(columns[i]).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, j in pairs]
    sums = good.groupBy(identity([by]).alias("id_")).agg(F.count(F.lit(1)).alias("n_"), *parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            k, n = len(columns) + 1, t["n_"].to_numpy(float)
            gram = np.zeros((len(t), k, k))
            gram[:, 0, 0] = n
            for i, j in pairs:
                gram[:, i + 1, j + 1] = gram[:, j + 1, i + 1] = n * t[f"c{i}_{j}"]
            centre = t[[f"mean_{i}" for i in range(len(columns))]].to_numpy(float)
            coef = solved(gram, centre)[0]
            few = n <= len(terms)
            coef[few] = 0
            coef[few, 0] = centre[few, 0]
            yield pd.DataFrame({"id_": t["id_"], "coef": list(coef)})

    coefs = sums.mapInPandas(run, "id_ string, coef array<double>")
    fitted = sum((F.col("coef")[i + 1] * F.col(c) for i, c in enumerate(terms)), F.col("coef")[0])
    return good.withColumn("id_", identity([by])).join(coefs, "id_").select(by, *key, (F.col(y) - fitted).alias("residual"))
