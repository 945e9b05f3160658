"""Quality rules (10): robust multivariate outliers.

Every text gets counts by fixed rules. The counts, transformed, form a vector of five statistics; for each
language and source the minimum covariance determinant (MCD) gives a centre and a scatter that junk can't
pull, and a text whose Mahalanobis distance from the centre is too large is rejected.

The MCD is computed over all rows, by concentration steps (C-steps) that Spark runs for all groups at
once: from deterministic starts, each step takes the share `SUPPORT` of a group with the smallest
distances, to the edge of a histogram bin, and makes mean and covariance anew. A step is one aggregation by
(group, start, bin) with map-side sums, so a group of any size is only ever sums in a task. Of the starts
the one with the smallest determinant counts; one reweighting follows, as is usual.

Cases: null text is empty and has no words (base rule fails). Null lang or source is a value of its own.
Groups under `MIN_ROWS` rows use the estimate of their language, small languages the one of all texts; with
fewer than `MIN_ROWS` texts in all there is no verdict beyond the base rules. An empty table gives an
empty result. Repeated rows are judged alike, each on its own row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import flat
from recollect.session import cut_lineage

WIDTH = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
SYMBOLS = b"#*$%&|<>"

P = 5
SUPPORT = 0.75
STEPS = 5
MIN_ROWS = 5 * P  # the usual least number of rows for an MCD
CUT = 0.99999
# Least standard deviation of each transformed statistic: most texts have no symbols, repeated lines or
# windows at all, and a few of them don't make a text junk.
FLOORS = (0.10, 0.05, 0.15, 0.13, 0.50)
BINS_PER_OCTAVE = 8

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def count_rules(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; see `measured` for their meaning."""
    n = len(at) - 1
    starts, ends, of = flat.blank_words(data, at)
    n_words = np.bincount(of, minlength=n)
    per_text = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at])
    code_points = (data & 0xC0) != 0x80
    in_word = ~flat.member(flat.BLANKS)[data]
    hashes = flat.run_hashes(data, starts, ends)
    return {
        "n_words": n_words, "word_chars": per_text(code_points & in_word),
        "n_symbols": per_text(flat.member(SYMBOLS)[data]),
        "n_repeat_words": _repeated(hashes, of, n), **_lines(data, at, in_word, n),
    }


def _twice(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seen before, seen more than once) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return later, any_


def _lines(data, at, in_word, n) -> dict[str, np.ndarray]:
    starts, ends, of = flat.tokens(data, at, data != 10)
    sums = np.concatenate([[0], np.cumsum(in_word)])
    wordy = sums[ends] > sums[starts]
    starts, ends, of = starts[wordy], ends[wordy], of[wordy]
    later, _ = _twice(flat.run_hashes(data, starts, ends) ^ flat.mix(of.astype(np.uint64)))
    return {"n_lines": np.bincount(of, minlength=n), "n_dup_lines": np.bincount(of[later], minlength=n)}


def _repeated(hashes: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    windows = flat.window_hashes(hashes, WIDTH)
    if not len(windows):
        return np.zeros(n, np.int64)
    inside = np.flatnonzero(of[:len(windows)] == of[WIDTH - 1:])
    _, twice = _twice(windows[inside] ^ flat.mix(of[inside].astype(np.uint64)))
    begins = inside[twice]
    covered = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + WIDTH, -1)
    return np.bincount(of[np.cumsum(covered)[:-1] > 0], minlength=n)


def measured(docs: DataFrame, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, lang, source, if wanted the `_whole` row, and n_words,
    word_chars (code points in words), n_symbols, n_lines (with a word), n_dup_lines (equal to an
    earlier one) and n_repeat_words (words in windows of five that occur twice or more)."""
    def run(batches):
        for batch in batches:
            for part in flat.slices(flat.with_text(batch) if whole else batch):
                counts = count_rules(*flat.flatten(part.column("text")))
                kept = [(name, part.column(name)) for name in part.schema.names if name != "text"]
                made = [(name, pa.array(counts[name].astype(np.int64))) for name in names]
                yield pa.RecordBatch.from_arrays([a for _, a in kept + made], names=[k for k, _ in kept + made])

    names = [c.split()[0] for c in COUNTS.split(", ")]
    told = docs.select("doc_id", "lang", "source", F.struct("*").alias("_whole") if whole else "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.schema.fields if f.name != "text")
    return told.mapInArrow(run, f"{schema}, {COUNTS}")


def base_failed():
    """The fixed part of the rules."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def vector() -> list:
    """The transformed statistics: word length, symbols, repeated lines, repeated windows, text length."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("word_chars") / words),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
        F.log1p(F.col("n_words")),
    ]


# --- chi-squared numbers -----------------------------------------------------------------------------

def chi2_cdf(x: float, k: int) -> float:
    """P(chi-squared with k degrees <= x), by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = k / 2, x / 2
    term = total = math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    i = 1
    while term > 1e-17 * total and i < 10_000:
        term *= y / (a + i)
        total += term
        i += 1
    return min(1.0, total)


def chi2_quantile(q: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


def consistency(share: float) -> float:
    """By what the covariance of the innermost share of normal rows has to be multiplied."""
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


# --- MCD ---------------------------------------------------------------------------------------------

X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
MODEL = "grp string, start int, logdet double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(
    f"p{i}{j} double" for i, j in PAIRS)


def _model(key: pd.DataFrame, mean: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Rows of MODEL: floors on the variances, determinant and inverse."""
    for i in range(P):
        cov[:, i, i] += FLOORS[i] ** 2
    precision = np.linalg.inv(cov) if len(cov) else cov
    out = {"grp": key["grp"].to_numpy(), "start": key["start"].to_numpy(),
           "logdet": np.linalg.slogdet(cov)[1] if len(cov) else np.zeros(0)}
    out |= {f"m{i}": mean[:, i] for i in range(P)}
    out |= {f"p{i}{j}": precision[:, i, j] * (1 if i == j else 2) for i, j in PAIRS}
    return pd.DataFrame(out)


def _refit(factor: float):
    def run(frames):
        for f in frames:
            n = f["n"].to_numpy(float)
            mean = np.stack([f[f"s{i}"].to_numpy(float) / n for i in range(P)], axis=1)
            cov = np.zeros((len(f), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = factor * (f[f"q{i}{j}"].to_numpy(float) / n - mean[:, i] * mean[:, j])
            yield _model(f, mean, cov)

    return run


def _distance():
    diff = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(X)]
    return sum((diff[i] * diff[j] * F.col(f"p{i}{j}") for i, j in PAIRS), F.lit(0.0))


def _moments() -> list:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)],
            *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS]]


def _sum_moments() -> list:
    return [F.sum(c).alias(c) for c in ["n", *[f"s{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS]]]


def _starts(rows: DataFrame) -> DataFrame:
    """Two deterministic starts for each group: medians with the deviations from them, and the
    covariance of the spatial signs around the medians."""
    # medians to a fixed grid of the value range, so that they don't depend on the order of merging
    step = 1 / 256
    long = rows.select("grp", F.posexplode(F.array(*X)).alias("dim", "x")).groupBy(
        "grp", "dim", F.floor(F.col("x") / step).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    half = _first_past(long, ["grp", "dim"], 0.5).select("grp", "dim", ((F.col("bin") + 0.5) * step).alias("med"))
    medians = half.groupBy("grp").agg(*[F.max(F.when(F.col("dim") == i, F.col("med"))).alias(f"c{i}") for i in range(P)])
    centred = rows.join(cut_lineage(medians), "grp")
    for i, x in enumerate(X):
        centred = centred.withColumn(x, (F.col(x) - F.col(f"c{i}")) / FLOORS[i])
    size = F.sqrt(sum((F.col(x) * F.col(x) for x in X), F.lit(1e-12)))
    signs = centred.withColumn("_s", size).select("grp", *[(F.col(x) / F.col("_s")).alias(x) for x in X], *[
        F.least(F.abs(F.col(x)), F.lit(20.0)).alias(f"a{x}") for x in X])
    sums = signs.groupBy("grp").agg(*_moments(), *[F.avg(f"a{x}").alias(f"d{i}") for i, x in enumerate(X)])
    both = sums.join(medians, "grp").withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    floors = np.array(FLOORS)

    def run(frames):
        for f in frames:
            mean = np.stack([f[f"c{i}"].to_numpy(float) for i in range(P)], axis=1)
            dev = np.stack([f[f"d{i}"].to_numpy(float) for i in range(P)], axis=1) * floors * 1.25
            cov = np.zeros((len(f), P, P))
            n, second = f["n"].to_numpy(float), (f["start"] == 1).to_numpy()
            for i, j in PAIRS:
                scale = P * np.where(second, f[f"q{i}{j}"].to_numpy(float) / n, float(i == j) / P)
                cov[:, i, j] = cov[:, j, i] = scale * dev[:, i] * dev[:, j]
            yield _model(f, mean, cov)

    return both.mapInPandas(run, MODEL)


def _first_past(bins: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The first bin by which `share` of the rows of a key are reached; one row per bin comes in."""
    every = Window.partitionBy(*keys)
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    summed = bins.withColumn("_upto", F.sum("n").over(upto)).withColumn("_all", F.sum("n").over(every))
    return summed.where((F.col("_upto") >= share * F.col("_all")) & (F.col("_upto") - F.col("n") < share * F.col("_all")))


def _c_step(rows: DataFrame, model: DataFrame) -> DataFrame:
    near = rows.join(model.drop("logdet"), "grp").select(
        "grp", "start", *X, F.floor(F.log2(_distance() + 1e-6) * BINS_PER_OCTAVE).alias("bin"))
    bins = near.groupBy("grp", "start", "bin").agg(*_moments())
    upto = Window.partitionBy("grp", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("grp", "start")
    inner = (bins.withColumn("_before", F.sum("n").over(upto) - F.col("n"))
             .withColumn("_all", F.sum("n").over(every)).where(F.col("_before") < SUPPORT * F.col("_all")))
    sums = inner.groupBy("grp", "start").agg(*_sum_moments())
    return sums.mapInPandas(_refit(consistency(SUPPORT)), MODEL)


def mcd(rows: DataFrame) -> DataFrame:
    """Centre and precision (MODEL) of each `grp` of rows with columns x0 to x4."""
    model = cut_lineage(_starts(rows))
    for _ in range(STEPS):
        model = cut_lineage(_c_step(rows, model))
    best = cut_lineage(model.groupBy("grp").agg(
        F.min_by(F.struct("*"), F.struct("logdet", "start")).alias("b")).select("b.*"))
    inner = rows.join(best, "grp").where(_distance() <= chi2_quantile(0.975, P))
    sums = inner.groupBy("grp", "start").agg(*_moments())
    return cut_lineage(sums.mapInPandas(_refit(consistency(0.975)), MODEL))


def _own():
    return F.to_json(F.struct(F.lit("ls").alias("k"), "lang", "source"))


def estimates(counted: DataFrame) -> DataFrame:
    """The estimate that each language and source is judged by: `own` names the pair, m0.. and p00..
    hold centre and precision. `counted` comes from `measured`; all its rows that pass the base rules
    count, also for the estimates of their language and of all texts where those are in use."""
    lang = F.to_json(F.struct(F.lit("l").alias("k"), "lang"))
    fit = counted.where(~base_failed()).select(
        *[c.alias(x) for c, x in zip(vector(), X)], _own().alias("own"), lang.alias("wide"))
    sizes = cut_lineage(fit.groupBy("own", "wide").agg(F.count(F.lit(1)).alias("n")))
    levels = sizes.join(sizes.groupBy("wide").agg(F.sum("n").alias("n_wide")), "wide")
    use = F.when(F.col("n") >= MIN_ROWS, F.col("own")).when(F.col("n_wide") >= MIN_ROWS, F.col("wide")).otherwise("all")
    chosen = cut_lineage(levels.select("own", "wide", use.alias("grp")))
    needed = chosen.select("grp").distinct()
    member = cut_lineage(chosen.select("own", F.explode(F.array("own", "wide", F.lit("all"))).alias("grp")).join(
        needed, "grp", "left_semi"))
    rows = cut_lineage(fit.drop("wide").join(member, "own").select(*X, "grp"))
    enough = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS).select("grp")
    model = mcd(rows.join(enough, "grp", "left_semi"))
    return cut_lineage(chosen.join(model, "grp").drop("grp", "wide", "start", "logdet"))


def verdicts(counted: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of `measured` with base_failed, distance2 (null where no estimate applies) and kept.
    `found` (from `estimates`) has one short row per language and source; Spark broadcasts it while its
    written size allows and shuffles otherwise."""
    names = counted.columns
    told = counted.select(*names, *[c.alias(x) for c, x in zip(vector(), X)], _own().alias("own"), base_failed().alias("base_failed"))
    distance = F.when(~F.col("base_failed"), _distance())
    return told.join(found, "own", "left").select(
        *names, "base_failed", distance.alias("distance2"),
        (~F.col("base_failed") & F.coalesce(distance <= chi2_quantile(CUT, P), F.lit(True))).alias("kept"))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, source, its counts, base_failed, distance2 and kept."""
    counted = cut_lineage(measured(docs))
    return verdicts(counted, estimates(counted))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, as they are. Texts are counted once for the estimates and once
    for the verdict, which costs less than moving or writing them."""
    found = estimates(cut_lineage(measured(docs)))
    return verdicts(measured(docs, whole=True), found).where("kept").select("_whole.*")
