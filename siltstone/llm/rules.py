"""Quality rules: base limits on counts, then robust outliers of transformed statistics by language and source.

The location and scatter of each group are minimum-covariance-determinant estimates: from medians and two robust
scales, concentration steps take the half of the rows with the smallest distances and estimate anew until that
settles; the start with the smaller determinant wins, and all rows near its estimate are then estimated from.  All
rows take part; each step is one pass that sums moments by group and band of distance, so no group has to be in one
place.  Of the band in which the half is reached, rows count by the share that is still wanted.  A group's estimate is
drawn towards that of its language, and the language's towards that of all rows, the more the fewer rows it has.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices, tidy
from siltstone.llm.durable import written

#: What counts as a symbol and as white space.
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\v\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_letters", "n_upper", "n_digits", "n_lines")
#: Transformed statistics, and the least standard deviation that each is given: spreads below these say nothing
#: about quality (a corpus without symbols has a spread of zero).
FLOORS = {"z_symbol": 0.05, "z_upper": 0.06, "z_other": 0.05, "z_length": 0.10, "z_repeat": 0.20, "z_dup": 0.20}
#: Bands of distance: so many to an octave.
OCTAVE = 16
BANDS, BAND_LOW = 24 * OCTAVE, -10.0


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS and MORE of the whole text; zeros for null."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    length = len(text) - sum(map(text.count, SPACES))
    windows = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = 0
    if n > 2 and len(windows) < n - 2:
        upto = 0
        for k in range(n - 2):
            if windows[words[k], words[k + 1], words[k + 2]] > 1:
                repeated += k + 3 - max(upto, k)
                upto = k + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    plain = text.encode("utf-32-le")
    codes = np.frombuffer(plain, np.uint32)
    low = codes[codes < 0x250]
    kinds = _KIND[low]
    letters, upper, digits = (int((kinds & bit > 0).sum()) for bit in (1, 2, 4))
    if len(low) < len(codes):
        rest = [chr(c) for c in codes[codes >= 0x250]]
        letters, upper, digits = letters + sum(map(str.isalpha, rest)), upper + sum(map(str.isupper, rest)), digits + sum(map(str.isdigit, rest))
    return n, length, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, letters, upper, digits, len(lines)


_KIND = np.array([chr(c).isalpha() + 2 * chr(c).isupper() + 4 * chr(c).isdigit() for c in range(0x250)], np.uint8)


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS and MORE as longs; columns of these names are replaced, all others are carried."""
    names = [*COUNTS, *MORE]
    df = df.drop(*(n for n in names if n != text))
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType(), False) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1 << 19):
            rows = np.array([counts(t) for t in b.column(text).to_pylist()], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, rows.T.copy())], schema.names)
        tidy()

    return df.mapInArrow(run, schema)


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def transformed() -> dict[str, Column]:
    """Shares on the scale of arcsine roots, and the logarithm of the mean word length."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a) / F.greatest(F.lit(1), F.col(b)))))
    return {
        "z_symbol": share(F.col("n_symbols"), "word_chars"),
        "z_upper": share(F.col("n_upper"), "n_letters"),
        "z_other": share(F.expr("word_chars - n_letters - n_digits - n_symbols"), "word_chars"),
        "z_length": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
        "z_repeat": share(F.col("n_repeat_words"), "n_words"),
        "z_dup": share(F.col("n_dup_lines"), "n_lines"),
    }


def chi2_share(x: float, p: float) -> float:
    """Share of a chi-square distribution below x, by the incomplete gamma function's series."""
    if x <= 0:
        return 0.0
    term = total = 1 / (p / 2)
    k = 1
    while term > total * 1e-17:
        term *= (x / 2) / (p / 2 + k)
        total += term
        k += 1
    return min(1.0, total * math.exp(-x / 2 + p / 2 * math.log(x / 2) - math.lgamma(p / 2)))


def chi2_quantile(p: float, share: float) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_share(mid, p) < share else (lo, mid)
    return lo


def distance(names: list[str], mean: str = "mean", inverse: str = "inverse") -> Column:
    """Squared Mahalanobis distance of the columns from a mean (array) under an inverse scatter (flat array)."""
    d = [F.col(n) - F.col(mean)[k] for k, n in enumerate(names)]
    total = F.lit(0.0)
    for i in range(len(names)):
        for j in range(i, len(names)):
            total = total + d[i] * d[j] * F.col(inverse)[i * len(names) + j] * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _levels(stats: DataFrame, by: list[str]) -> DataFrame:
    """A row for each level it counts for: all, its first column's group, its first two columns' group, and so on."""
    keys = [_key(by[:k]) for k in range(len(by) + 1)]
    return stats.withColumn("group", F.explode(F.array(*keys)))


def _key(by: list[str]) -> Column:
    """Text of the values; null differs from every text."""
    return F.to_json(F.struct(F.lit(len(by)).alias("level"), *(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(by))))


def _lists(rows: Iterable[np.ndarray]) -> pa.Array:
    return pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))


def fit_mcd(stats: DataFrame, names: list[str], by: list[str], floors: dict[str, float], share: float = 0.5, steps: int = 12, near: float = 0.975) -> DataFrame:
    """(group, n, mean, inverse) of every level's groups. stats: one row per document, without nulls in `names`.

    At most `steps` concentration steps, fewer if all determinants settle; then one estimate from the rows within
    `near` of the chi-square distribution.
    """
    p = len(names)
    rows = _levels(stats.select(*names, *by), by).drop(*by)
    quartiles = rows.groupBy("group").agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 2000).alias(c) for c in names))
    floor2 = np.array([floors[c] ** 2 for c in names])
    # the nearest rows' scatter is too small by this
    grow, cut = share / chi2_share(chi2_quantile(p, share), p + 2), chi2_quantile(p, near)
    grow_near = near / chi2_share(cut, p + 2)
    schema = "group string, start int, n long, mean array<double>, inverse array<double>, size double"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scales by the quartile range, and by the nearer quartile: outliers on one side can take the other."""
        for b in batches:
            q = np.array([b.column(c).to_pylist() for c in names], np.float64).reshape(p, -1, 3).transpose(1, 0, 2)
            low, high = q[:, :, 1] - q[:, :, 0], q[:, :, 2] - q[:, :, 1]
            for start, scale in enumerate([(low + high) / 1.349, 2 * np.minimum(low, high) / 1.349]):
                inverse = [np.diag(1 / (s**2 + floor2)).ravel() for s in scale]
                yield pa.RecordBatch.from_arrays([b.column("group"), pa.array([start] * len(q), pa.int32()), b.column("n"), _lists(q[:, :, 1]), _lists(inverse), pa.array([np.inf] * len(q))], ["group", "start", "n", "mean", "inverse", "size"])

    model = written(quartiles.mapInArrow(begin, schema), "mcd-0")
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    moments = [*(F.sum(c).alias(f"s{i}") for i, c in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i, j in pairs)]

    def estimate(sums: pa.Table, weight: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Mean and scatter, with the floors, of weighted sums of moments."""
        held = lambda columns: np.array([sums.column(c).to_numpy() for c in columns])
        total = (sums.column("n").to_numpy() * weight).sum()
        m = held([f"s{i}" for i in range(p)]) @ weight / total
        cross = held([f"c{i}_{j}" for i, j in pairs]) @ weight / total
        scatter = np.zeros((p, p))
        for (i, j), c in zip(pairs, cross, strict=True):
            scatter[i, j] = scatter[j, i] = c - m[i] * m[j]
        return m, scatter * factor + np.diag(floor2)

    def concentrate(bands: pa.Table) -> pa.Table:
        """Moments of the bands nearest the centre that hold the wanted share of the group, the last of them in part."""
        bands = bands.sort_by("band")
        n = bands.column("n").to_numpy()
        weight = np.clip((share * n.sum() - (np.cumsum(n) - n)) / n, 0, 1)
        m, scatter = estimate(bands, weight, grow)
        key = bands.select(["group", "start"]).slice(0, 1)
        return pa.table({**{c: key.column(c) for c in ("group", "start")}, "n": pa.array([int(n.sum())]), "mean": _lists([m]), "inverse": _lists([np.linalg.inv(scatter).ravel()]), "size": pa.array([float(np.linalg.slogdet(scatter)[1])])})

    def reweigh(sums: pa.Table) -> pa.Table:
        m, scatter = estimate(sums, np.ones(len(sums)), grow_near)
        return pa.table({"group": sums.column("group").slice(0, 1), "n": sums.column("whole").slice(0, 1), "mean": _lists([m]), "inverse": _lists([np.linalg.inv(scatter).ravel()])})

    for k in range(steps):
        seen = rows.join(model.select("group", "start", "mean", "inverse"), "group")
        band = F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor((F.log2(distance(names) + 1e-9) - BAND_LOW) * OCTAVE))).cast("int")
        sums = seen.groupBy("group", "start", band.alias("band")).agg(F.count("*").alias("n"), *moments)
        former, model = model, written(sums.groupBy("group", "start").applyInArrow(concentrate, schema), f"mcd-{k + 1}")
        moved = model.join(former.select("group", "start", F.col("size").alias("former")), ["group", "start"]).where(F.abs(F.col("size") - F.col("former")) > 1e-3)
        if not moved.limit(1).count():
            break
    best = model.groupBy("group").agg(F.min_by(F.struct("n", "mean", "inverse"), F.struct("size", "start")).alias("best")).select("group", "best.*")
    seen = rows.join(best.withColumnRenamed("n", "whole"), "group").where(distance(names) <= cut)
    sums = seen.groupBy("group", "whole").agg(F.count("*").alias("n"), *moments)
    return written(sums.groupBy("group").applyInArrow(reweigh, "group string, n long, mean array<double>, inverse array<double>"), "mcd")


def drawn(model: DataFrame, levels: int, borrow: float) -> DataFrame:
    """(group, mean, inverse) of the groups of the last level: each estimate is mixed with that of the group which it is part of
    (mixed likewise before), as if that had `borrow` rows of the group."""
    schema = "group string, mean array<double>, inverse array<double>"
    names = ", ".join(["level int", *(f"k{i} string" for i in range(levels))])

    def mix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            means, inverses = [], []
            for n, *found in zip(*(b.column(c).to_pylist() for c in ("n", "mean", "inverse", "mean0", "inverse0")), strict=True):
                m, v, m0, v0 = map(np.array, found)
                w, p = n / (n + borrow), len(m)
                own, other = (np.linalg.inv(np.reshape(x, (p, p))) for x in (v, v0))
                means.append(w * m + (1 - w) * m0)
                inverses.append(np.linalg.inv(w * own + (1 - w) * other + w * (1 - w) * np.outer(m - m0, m - m0)).ravel())
            yield pa.RecordBatch.from_arrays([b.column("group"), _lists(means), _lists(inverses)], ["group", "mean", "inverse"])

    at = lambda k: model.where(F.col("group").startswith(f'{{"level":{k}'))
    former, every = at(0).select("group", "mean", "inverse"), at(0).first()
    for k in range(1, levels + 1):
        if k == 1:  # one row for all: literals, as wide as the statistics
            met = at(1).withColumns({f"{c}0": F.array(*map(F.lit, every[c])) for c in ("mean", "inverse")} if every else {f"{c}0": F.col(c) for c in ("mean", "inverse")})
        else:
            key = F.from_json("group", names)
            part_of = F.to_json(F.struct(F.lit(k - 1).alias("level"), *(key[f"k{i}"].alias(f"k{i}") for i in range(k - 1))))
            of = former.select(F.col("group").alias("part_of"), F.col("mean").alias("mean0"), F.col("inverse").alias("inverse0"))
            met = at(k).withColumn("part_of", part_of).join(of, "part_of")
        former = met.mapInArrow(mix, schema)
    return former


def judge(stats: DataFrame, by: tuple[str, ...] = ("lang", "source"), tail: float = 1e-4, borrow: float = 50.0, floors: dict[str, float] = FLOORS, share: float = 0.5, steps: int = 12) -> DataFrame:
    """Adds `base_failed`, `distance` (squared) and `kept` to the rows of `statistics`.

    A row is kept if it passes the base limits and its distance is within all but the tail of the chi-square
    distribution.  The estimate is that of the row's language and source, drawn towards the language's and that of all
    rows as by `borrow` rows of these.  Null and empty texts have no words and fail the base limits; null languages
    and sources are groups of their own; repeated rows are judged alike; an empty table, or one where no row passes
    the base limits, has no verdict beyond the base, and rows of a group that has none such have no distance.  Columns
    of the added names are replaced.  `stats` is read once for the estimates and once for the verdicts.
    """
    added = ["base_failed", "distance", "kept"]
    carried = [c for c in stats.columns if c not in added]
    names, values, own = list(floors), transformed(), "siltstone_mcd_"
    passed = stats.where(~base_failed()).select(*by, *(values[n].alias(n) for n in names))
    model = fit_mcd(written(passed, "statistics"), names, list(by), floors, share, steps)
    model = written(drawn(model, len(by), borrow), "drawn").select(F.col("group").alias(f"{own}group"), F.struct("mean", "inverse").alias(f"{own}model"))
    table = stats.withColumn(f"{own}group", _key(list(by))).join(model, f"{own}group", "left")
    table = table.withColumns({f"{own}{n}": values[n] for n in names})
    far = distance([f"{own}{n}" for n in names], f"{own}model.mean", f"{own}model.inverse")
    table = table.withColumn(f"{own}far", far).withColumn(f"{own}failed", base_failed())
    fine = ~F.col(f"{own}failed") & (F.coalesce(F.col(f"{own}far"), F.lit(0.0)) <= chi2_quantile(len(names), 1 - tail))
    return table.select(*carried, F.col(f"{own}failed").alias("base_failed"), F.col(f"{own}far").alias("distance"), fine.alias("kept"))
