"""Train/test splits (X3, X4) and cross-validation folds.

All draws are exact in size and independent of partitioning: a row's place in the
seeded order (portable hash, then key) decides its bin, and the cut points come from
bucket counts (``hash_rank_bins``) or a bounded rank selection (``lex_thresholds``).
No step sorts the table or puts a class or a time range into one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import phash
from ..functions.materialize import pin
from ..functions.ranks import hash_rank_bins, lex_bin, lex_thresholds

# Holdout share, number of folds, seeds of the split and of the folds.
TEST_SHARE_BP = 2000
N_FOLDS = 5
SPLIT_SEED = 42
FOLD_SEED = 43
#: A group with more than this part of all rows is placed by name.
HEAVY_PARTS = 10_000
#: Hashes (28 bits) in one range of the first round of sums.
HASH_RANGE = 1 << 14


def _fold_cuts(k: int) -> list[int]:
    return [round(10_000 * i / k) for i in range(1, k)]


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str], seed: int = SPLIT_SEED,
                     hash_cols: Sequence[str] | None = None) -> DataFrame:
    """Per class, the first ceil(20 %) rows of the seeded order are the test set.

    A class of one row can't be on both sides: the split is then drawn over all rows (X4)."""
    smallest = df.groupBy(F.col(f"`{label}`")).count().agg(F.min("count")).first()[0]
    if smallest is not None and smallest < 2:
        return random_split(df, key_cols, seed, hash_cols)
    b = hash_rank_bins(df, [label], key_cols, seed=seed, fractions_bp=[TEST_SHARE_BP], out_col="_bin",
                       hash_cols=hash_cols)
    return b.withColumn("split", F.when(F.col("_bin") == 0, "test").otherwise("train")).drop("_bin")


def random_split(df: DataFrame, key_cols: Sequence[str], seed: int = SPLIT_SEED,
                 hash_cols: Sequence[str] | None = None) -> DataFrame:
    """ceil(20 %) of all rows, seeded order."""
    b = hash_rank_bins(df, [], key_cols, seed=seed, fractions_bp=[TEST_SHARE_BP], out_col="_bin", hash_cols=hash_cols)
    return b.withColumn("split", F.when(F.col("_bin") == 0, "test").otherwise("train")).drop("_bin")


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = N_FOLDS, seed: int = FOLD_SEED,
          hash_cols: Sequence[str] | None = None) -> DataFrame:
    """Shuffled k-fold; fold i holds ranks [ceil(n*i/k), ceil(n*(i+1)/k))."""
    return hash_rank_bins(df, [], key_cols, seed=seed, fractions_bp=_fold_cuts(k), out_col="fold",
                          hash_cols=hash_cols)


def stratified_kfold(df: DataFrame, label: str, key_cols: Sequence[str], k: int = N_FOLDS,
                     seed: int = FOLD_SEED) -> DataFrame:
    """The same cut inside every class, so each fold keeps the class shares."""
    return hash_rank_bins(df, [label], key_cols, seed=seed, fractions_bp=_fold_cuts(k), out_col="fold")


@dataclass
class GroupFolds:
    """Where every group goes: heavy groups by name, all others by the range their hash lies in."""
    heavy: dict  # group -> fold
    cuts: list[int]  # a light group's fold is the number of cuts that its hash reaches
    seed: int = FOLD_SEED

    def apply(self, df: DataFrame, group: str) -> DataFrame:
        """``df`` with the column ``fold``: a narrow projection for light groups, a small lookup for heavy ones."""
        h = phash([group], self.seed, df)
        light = sum((F.when(h >= c, 1).otherwise(0) for c in self.cuts), F.lit(0))
        # rows without a group are a group of their own; its hash is that of the empty key
        light = F.when(F.col(f"`{group}`").isNull(), F.lit(self.heavy.get(None, 0))).otherwise(light)
        named = [(g, f) for g, f in self.heavy.items() if g is not None]
        if not named:
            return df.withColumn("fold", light.cast("int"))
        kind = df.schema[group].dataType.simpleString()
        look = df.sparkSession.createDataFrame(named, f"_heavy {kind}, _fold int")  # at most HEAVY_PARTS rows
        joined = df.join(F.broadcast(look), F.col(f"`{group}`") == F.col("_heavy"), "left")
        return joined.withColumn("fold", F.coalesce("_fold", light.cast("int"))).drop("_heavy", "_fold")


def fill(loads: Sequence[int], rest: int) -> list[int]:
    """How many of ``rest`` rows each fold takes so that all folds reach one level (full ones take none).

    The level is the least of the levels that the m smallest folds would reach alone, in whole rows."""
    low = sorted(loads)
    level = min((rest + sum(low[:m])) // m for m in range(1, len(low) + 1))
    return [max(0, level - x) for x in loads]


def balanced_groups(sizes: DataFrame, group: str, k: int = N_FOLDS, seed: int = FOLD_SEED) -> GroupFolds:
    """Assign whole groups to ``k`` folds of nearly equal numbers of rows.

    ``sizes`` has a row for each group with its ``n_rows``.  Groups that hold more than 1/HEAVY_PARTS of
    the rows (fewer than HEAVY_PARTS at any size), and the rows without a group, go one by one, the
    largest first, to the fold with the fewest rows so far.  All others are light: in the order of
    their hash they fill up the folds to one level.  Which hash a fold begins at follows from sums by
    hash range, then by hash inside the ranges that are cut; nothing is sorted and no light group is
    collected.  Groups that share a hash stay together."""
    total = sizes.agg(F.sum("n_rows")).first()[0] or 0
    is_heavy = (F.col("n_rows") * HEAVY_PARTS > total) | F.col(f"`{group}`").isNull()
    heavy = sorted(((r[0], r[1]) for r in sizes.filter(is_heavy).select(F.col(f"`{group}`"), "n_rows").collect()),
                   key=lambda r: (-r[1], r[0] is not None, r[0]))
    loads, where = [0] * k, {}
    for g, n in heavy:
        f = loads.index(min(loads))
        where[g] = f
        loads[f] += n
    shares = fill(loads, total - sum(loads))
    edges = [sum(shares[:f]) for f in range(1, k)]  # rows of light groups before each fold
    light = sizes.filter(~is_heavy).select(phash([group], seed, sizes).alias("h"), "n_rows")

    def sums(df: DataFrame, key: Column) -> list[tuple[int, int]]:
        rows = df.groupBy(key.alias("b")).agg(F.sum("n_rows").alias("n")).collect()  # at most 2^14 a range
        return sorted((int(r["b"]), int(r["n"])) for r in rows)

    ranges = sums(light, F.col("h").bitwiseAND(~(HASH_RANGE - 1)))
    cut_ranges = {}  # range -> rows before it
    before = 0
    for b, n in ranges:
        if any(before < e <= before + n for e in edges):
            cut_ranges[b] = before
        before += n
    inside = light.filter(F.col("h").bitwiseAND(~(HASH_RANGE - 1)).isin(list(cut_ranges))) if cut_ranges else None
    exact: dict[int, list] = {}
    for h, n in sums(inside, F.col("h")) if inside is not None else []:
        exact.setdefault(h & ~(HASH_RANGE - 1), []).append((h, n))
    cuts = []
    for e in edges:
        # the first hash with at least e rows before it
        cut = ranges[-1][0] + HASH_RANGE if ranges else 0
        if e <= 0:
            cut = 0
        for b, at in cut_ranges.items():
            if at < e <= at + sum(n for _, n in exact[b]):
                run = at
                cut = b + HASH_RANGE
                for h, n in exact[b]:
                    if run >= e:
                        cut = h
                        break
                    run += n
        cuts.append(cut)
    return GroupFolds(where, cuts, seed)


def group_kfold(df: DataFrame, group: str, k: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """Whole groups per fold, folds balanced by rows.  One row per group with its size and fold."""
    sizes = pin(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")))
    return balanced_groups(sizes, group, k, seed).apply(sizes, group)


def group_folded(df: DataFrame, group: str, k: int = N_FOLDS, seed: int = FOLD_SEED) -> DataFrame:
    """T3 on the rows: ``df`` with the column ``fold``.  The rows aren't shuffled for it."""
    sizes = pin(df.groupBy(group).agg(F.count(F.lit(1)).alias("n_rows")))
    return balanced_groups(sizes, group, k, seed).apply(df, group)


def time_series_folds(df: DataFrame, order: Column, key: str, k: int = N_FOLDS) -> DataFrame:
    """T4: with n rows in (time, key) order and test size t = n // (k+1), fold i is the
    block of ranks [n-(k-i)t, n-(k-i-1)t); earlier rows only ever train (fold -1), as do rows
    without a time, which have no rank.

    Cut points are k exact (time, key) thresholds from a bounded rank selection; the fold
    column is then a narrow projection (no shuffle, no window)."""
    timed = df.filter(order.isNotNull())
    n = timed.count()
    t = n // (k + 1)
    if t == 0:
        return df.withColumn("fold", F.lit(-1))
    ranks = [n - (k - i) * t for i in range(k)]
    th = lex_thresholds(timed, order, F.col(key), ranks, n)
    fold = F.when(order.isNotNull(), lex_bin(order, F.col(key), [th[r] for r in ranks]) - 1).otherwise(-1)
    return df.withColumn("fold", fold)


def epoch_micros(col: str) -> Column:
    """Time-zone free ordering value of a timestamp / timestamp_ntz column."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{col}` AS TIMESTAMP_NTZ))")


def time_holdout(df: DataFrame, order: Column, key: str, test_share_bp: int = TEST_SHARE_BP) -> DataFrame:
    """Z6 (and reference defect 12): a time-series task never gets a random split; the
    last ceil(20 %) rows in (time, key) order are the holdout."""
    timed = df.filter(order.isNotNull())  # rows without a time only ever train
    n = timed.count()
    k = n - (n * test_share_bp + 9999) // 10000
    if k >= n:
        return df.withColumn("split", F.lit("train"))
    th = lex_thresholds(timed, order, F.col(key), [k], n)[k]
    late = order.isNotNull() & (lex_bin(order, F.col(key), [th]) == 1)
    return df.withColumn("split", F.when(late, "test").otherwise("train"))
