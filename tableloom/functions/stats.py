"""Column statistics in single passes, and exact quantiles that scale.

``percentile`` keeps every distinct value of a column in one buffer, which is slow
for many values and unbounded for large tables. It is used only where a buffer
stays small. Otherwise the wanted order statistics are found by narrowing: one
pass counts rows per equal-width bin (with the least and greatest value of each
bin), the bin that holds the wanted rank is known exactly, and the next pass looks
only inside it. Data too uneven for equal bins is narrowed by a quantile sketch
whose proposals are checked by exact counts. No rows are moved in any pass. Long
lists of ranks are read off the counts of distinct values instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableloom.functions.columns import number, present, q
from tableloom.functions.keyed import rows_before

EXACT_ROWS = 1_000_000
BUFFER_ROWS = 20_000
BINS = 1024
BIN_ROWS = 200_000
MANY_RANKS = 64
COLUMNS_PER_JOB = 200
SKETCH_ACCURACY = 10_000

_NUMERIC: dict[str, Callable[[Column], Column]] = {
    "count": F.count,
    "mean": F.avg,
    "std": F.stddev_samp,
    "std_pop": F.stddev_pop,
    "var_pop": F.var_pop,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "max_abs": lambda c: F.max(F.abs(c)),
}


def numeric_stats(
    df: DataFrame, columns: Sequence[str], wanted: Sequence[str]
) -> dict[str, dict[str, float | None]]:
    """``{column: {statistic: value}}`` from one aggregation per column group."""
    found: dict[str, dict[str, float | None]] = {}
    for start in range(0, len(columns), COLUMNS_PER_JOB):
        part = columns[start : start + COLUMNS_PER_JOB]
        row = df.agg(
            *[
                _NUMERIC[stat](number(df, name)).alias(f"{i}:{stat}")
                for i, name in enumerate(part)
                for stat in wanted
            ]
        ).first()
        for i, name in enumerate(part):
            found[name] = {stat: row[f"{i}:{stat}"] for stat in wanted}
    return found


def null_counts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Row count and missing values per column in one pass."""
    rows, nulls = 0, {}
    for start in range(0, max(len(columns), 1), COLUMNS_PER_JOB):
        part = columns[start : start + COLUMNS_PER_JOB]
        row = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(part)],
        ).first()
        rows = row["rows"]
        nulls.update({c: rows - row[f"n{i}"] for i, c in enumerate(part)})
    return rows, nulls


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    counts: Mapping[str, int] | None = None,
    limit: int | None = None,
) -> dict[str, list[float] | None]:
    """Exact linearly interpolated quantiles per column; ``None`` where there are no values."""
    if not columns:
        return {}
    ends = None
    if counts is None:
        ends = numeric_stats(df, columns, ["count", "min", "max"])
        counts = {c: s["count"] for c, s in ends.items()}
    if limit is None:
        limit = EXACT_ROWS if len(probs) > MANY_RANKS // 2 else BUFFER_ROWS
    result: dict[str, list[float] | None] = {c: None for c in columns}
    small = [c for c in columns if 0 < counts[c] <= limit]
    for start in range(0, len(small), COLUMNS_PER_JOB):
        part = small[start : start + COLUMNS_PER_JOB]
        row = df.agg(
            *[
                F.percentile(number(df, c), F.array(*[F.lit(float(p)) for p in probs])).alias(str(i))
                for i, c in enumerate(part)
            ]
        ).first()
        result.update({c: list(row[str(i)]) for i, c in enumerate(part)})

    large = [c for c in columns if counts[c] > limit]
    if large:
        positions = {c: [p * (counts[c] - 1) for p in probs] for c in large}
        ranks = {
            c: sorted({int(r) for pos in positions[c] for r in (math.floor(pos), math.ceil(pos))})
            for c in large
        }
        values = order_statistics(
            df.select(*[number(df, c).alias(c) for c in large]), ranks, counts, limit, ends
        )
        for c in large:
            result[c] = [
                _between(values[c, math.floor(pos)], values[c, math.ceil(pos)], pos - math.floor(pos))
                for pos in positions[c]
            ]
    return result


def _between(low: float, high: float, share: float) -> float:
    return low if share == 0 or low == high else low + (high - low) * share


class _Open:
    """Interval that still holds a wanted rank: bounds as ``(value, belongs to it)``."""

    __slots__ = ("above", "below_rows", "even", "rows", "under")

    def __init__(self, rows: int):
        self.above: tuple[float, bool] | None = None
        self.under: tuple[float, bool] | None = None
        self.below_rows = 0
        self.rows = rows
        self.even = True

    def inside(self, column: Column) -> Column:
        test = column.isNotNull()
        if self.above is not None:
            value, belongs = self.above
            test &= column >= F.lit(value) if belongs else column > F.lit(value)
        if self.under is not None:
            value, belongs = self.under
            test &= column <= F.lit(value) if belongs else column < F.lit(value)
        return F.when(test, column)

    def bounds(self) -> tuple:
        return self.above, self.under


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    counts: Mapping[str, int],
    limit: int = BUFFER_ROWS,
    ends: Mapping[str, Mapping[str, float]] | None = None,
) -> dict[tuple[str, int], float]:
    """Values at zero-based ranks among the non-null values of double columns."""
    solved: dict[tuple[str, int], float] = {}
    for c, wanted in ranks.items():
        if len(wanted) > MANY_RANKS:
            solved.update(_from_value_counts(df, c, wanted, counts[c]))
    pending = {
        (c, r): _Open(counts[c]) for c, wanted in ranks.items() if len(wanted) <= MANY_RANKS for r in wanted
    }
    if pending:
        names = list({c for c, _ in pending})
        ends = ends or numeric_stats(df, names, ["min", "max"])
        for (c, _), state in pending.items():
            state.above, state.under = (ends[c]["min"], True), (ends[c]["max"], True)
    while pending:
        for key in [k for k, o in pending.items() if o.above == o.under]:
            solved[key] = float(pending.pop(key).above[0])
        ready = [k for k, o in pending.items() if o.rows <= limit]
        if ready:
            _finish(df, ready, pending, solved)
            continue
        even = [k for k, o in pending.items() if o.even]
        if even:
            _narrow_by_bins(df, even, pending)
        elif pending:
            _narrow_by_sketch(df, pending, solved)
    return solved


def _finish(df: DataFrame, ready: list, pending: dict, solved: dict) -> None:
    """A point a little above the rank, then the largest value not above it: exactly the value at the rank."""
    near = df.agg(
        *[
            F.percentile(
                pending[k].inside(q(k[0])),
                F.lit(min((k[1] - pending[k].below_rows + 0.25) / max(pending[k].rows - 1, 1), 1.0)),
            ).alias(str(i))
            for i, k in enumerate(ready)
        ]
    ).first()
    row = df.agg(
        *[F.max(F.when(q(k[0]) <= near[str(i)], q(k[0]))).alias(str(i)) for i, k in enumerate(ready)]
    ).first()
    for i, k in enumerate(ready):
        solved[k] = float(row[str(i)])
        del pending[k]


def _narrow_by_bins(df: DataFrame, keys: list, pending: dict) -> None:
    """One pass for all open intervals; ranks that share an interval share its bins."""
    intervals = list({(k[0], pending[k].bounds()): pending[k] for k in keys}.items())
    bins = max(16, min(BINS, BIN_ROWS // len(intervals)))
    cells = []
    for i, ((c, _), state) in enumerate(intervals):
        low, high = state.above[0], state.under[0]
        x = state.inside(q(c))
        # halves first, so that the width of extreme intervals stays finite
        width = high / 2 - low / 2
        place = F.floor((x / 2 - low / 2) / F.lit(width) * bins)
        cells.append(F.struct(
            F.lit(i).alias("interval"), F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0)).cast("int").alias("bin"),
            x.alias("x"),
        ))
    rows = (
        df.select(F.inline(F.array(*cells))).filter(F.col("x").isNotNull())
        .groupBy("interval", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()
    )
    table: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["interval"], r["bin"])):
        table.setdefault(r["interval"], []).append(r)
    number_of = {key: i for i, (key, _) in enumerate(intervals)}
    for k in keys:
        state = pending[k]
        before = state.below_rows
        for r in table[number_of[k[0], state.bounds()]]:
            if k[1] < before + r["n"]:
                state_new = _Open(r["n"])
                state_new.above, state_new.under, state_new.below_rows = (r["lo"], True), (r["hi"], True), before
                state_new.even = r["n"] * 4 <= state.rows
                pending[k] = state_new
                break
            before += r["n"]


def _narrow_by_sketch(df: DataFrame, pending: dict, solved: dict) -> None:
    margin = 2.0 / SKETCH_ACCURACY
    keys = list(pending)
    guesses = df.agg(
        *[
            F.percentile_approx(
                pending[k].inside(q(k[0])),
                [max(share - margin, 0.0), min(share + margin, 1.0)],
                SKETCH_ACCURACY,
            ).alias(str(i))
            for i, k in enumerate(keys)
            for share in [(k[1] - pending[k].below_rows + 0.5) / pending[k].rows]
        ]
    ).first()
    checks = df.agg(
        *[
            F.count_if(test).alias(f"{i}:{name}")
            for i, k in enumerate(keys)
            for low, high in [guesses[str(i)]]
            for name, test in (
                ("lt_low", q(k[0]) < low),
                ("le_low", q(k[0]) <= low),
                ("lt_high", q(k[0]) < high),
                ("le_high", q(k[0]) <= high),
            )
        ]
    ).first()
    for i, k in enumerate(keys):
        _place(
            k, pending, solved, guesses[str(i)],
            [checks[f"{i}:{n}"] for n in ("lt_low", "le_low", "lt_high", "le_high")],
        )


def _place(key, pending, solved, guess, counted) -> None:
    rank, state = key[1], pending[key]
    (low, high), (lt_low, le_low, lt_high, le_high) = guess, counted
    end = state.below_rows + state.rows
    if rank < lt_low:
        state.under, state.rows = (low, False), lt_low - state.below_rows
    elif rank < le_low:
        solved[key] = float(low)
        del pending[key]
    elif rank < lt_high:
        state.above, state.under = (low, False), (high, False)
        state.below_rows, state.rows = le_low, lt_high - le_low
    elif rank < le_high:
        solved[key] = float(high)
        del pending[key]
    else:
        state.above, state.below_rows, state.rows = (high, False), le_high, end - le_high


def _from_value_counts(df: DataFrame, column: str, ranks: Sequence[int], rows: int) -> dict[tuple[str, int], float]:
    """Many ranks at once: distinct values with the rows before them, matched to the ranks by stretches of rank."""
    counts = df.select(q(column).alias("x")).filter(F.col("x").isNotNull()).groupBy("x").agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = rows_before(counts, [F.col("x")], "n", "start")
    stretch = max(1, rows // 4096)
    spans = placed.withColumn(
        "stretch",
        F.explode(F.sequence(
            F.floor(F.col("start") / stretch), F.floor((F.col("start") + F.col("n") - 1) / stretch)
        )),
    )
    wanted = df.sparkSession.createDataFrame([(int(r), int(r) // stretch) for r in ranks], "r bigint, stretch bigint")
    # the ranks are a short list
    hits = spans.join(F.broadcast(wanted), "stretch").filter(
        (F.col("r") >= F.col("start")) & (F.col("r") < F.col("start") + F.col("n"))
    )
    return {(column, row["r"]): float(row["x"]) for row in hits.select("r", "x").collect()}


def value_counts(
    df: DataFrame, columns: Sequence[str], extra: Mapping[str, tuple[Column, Callable]] | None = None
) -> DataFrame:
    """``(column, value, n, …)`` for all columns in one shuffle of partial counts.

    ``extra`` maps an output name to ``(row expression, aggregate)``.
    """
    extra = extra or {}
    carried = [expr.alias(name) for name, (expr, _) in extra.items()]
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), present(df, c).cast("string").alias("value")) for c in columns]
    )
    long = df.select(F.explode(pairs).alias("pair"), *carried).select("pair.column", "pair.value", *extra)
    return long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"),
        *[aggregate(F.col(name)).alias(name) for name, (_, aggregate) in extra.items()],
    )


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column; the smallest wins a tie."""
    if not columns:
        return {}
    numeric = set(c for c in columns if dict(df.dtypes)[c] != "string")
    counted = value_counts(df, columns).filter(F.col("value").isNotNull())
    # numeric ties are broken by number, text ties by text
    top = counted.groupBy("column").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("text"),
        F.min_by("value", F.struct(-F.col("n"), F.expr("try_cast(value as double)"))).alias("num"),
    )
    found = {r["column"]: (r["num"] if r["column"] in numeric else r["text"]) for r in top.collect()}
    return {c: found.get(c) for c in columns}
