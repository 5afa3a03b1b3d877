"""Windows over one series: all tags, ordered by time."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """The tags that tell series apart, the time column (milliseconds), and columns that order rows of one series and time."""

    tags: tuple[str, ...] = ()
    time: str = "time"
    order: tuple[str, ...] = ()

    @property
    def w(self) -> WindowSpec:
        by = [F.col(t) for t in self.tags] or [F.lit(0)]
        return Window.partitionBy(*by).orderBy(self.time, *self.order)

    @property
    def cumulative(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def same_time(self) -> WindowSpec:
        """The rows of this time up to this one."""
        by = [F.col(c) for c in (*self.tags, self.time)]
        return Window.partitionBy(*by).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, Window.currentRow)

    @property
    def before(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def after(self) -> WindowSpec:
        """The rows after this one, in reverse: the nearest is the last.  Spark folds a frame that grows; one that shrinks it would read anew for each row."""
        by = [F.col(t) for t in self.tags] or [F.lit(0)]
        return Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in (self.time, *self.order))).rowsBetween(Window.unboundedPreceding, -1)

    @property
    def whole(self) -> WindowSpec:
        return self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def number(x: Column) -> Column:
    """Value of a numeric or boolean field as double."""
    return x.cast("double")


def scan(df: DataFrame, series: Series, inputs: list[Column], out: str, start: Callable[[], Callable[..., float | bool | None]], kind: str = "double") -> DataFrame:
    """Adds ``out`` by a fold along each series, in bounded memory.

    Rows are dealt by series and sorted by time; each Arrow batch runs through
    ``start()``'s step function, whose state lives on over batches.  One series is
    never held whole.
    """
    names = [f"__in{i}" for i in range(len(inputs))]
    prepared = df.withColumns(dict(zip(names, inputs, strict=True)))
    by = list(series.tags)
    dealt = prepared.repartition(*by) if by else prepared.repartition(1)
    ordered = dealt.sortWithinPartitions(*by, series.time, *series.order)
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for batch in batches:
            keys = list(zip(*(batch[t].tolist() for t in by))) if by else [()] * len(batch)
            values = []
            for k, *xs in zip(keys, *(batch[n].tolist() for n in names)):
                k = tuple(None if v != v else v for v in k)
                if state is None or k != key:
                    state, key = start(), k
                values.append(state(*xs))
            batch = batch.drop(columns=names)
            batch[out] = pd.Series(values, index=batch.index, dtype="object")
            yield batch

    return ordered.mapInPandas(run, schema)
