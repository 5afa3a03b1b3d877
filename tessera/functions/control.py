"""PID control: bucket output of a controller, and identification of its parameters from a step response."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the two-point method: how many time constants pass before the 35 % and the 85 % point;
#: and the fewest samples.
BEFORE_35, BEFORE_85, LEAST_SAMPLES = 0.4308, 1.8971, 10
#: Rows of a slab of time, about.
ROWS = 1 << 17


def pid(df: DataFrame, keys: list[str], time: str, f: Column, setpoint: float, kp: float, ki: float, kd: float, out: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row for each key: the last output of a controller that starts fresh in it.

    Closed form: the error integral is a sum over rows, so no state crosses rows.
    ``ties`` order rows of one time, of which the first gives the output.
    """
    from pyspark.sql import Window

    by = [F.col(k) for k in keys] or [F.lit(0)]
    points = df.withColumn("__e", float(setpoint) - f.cast("double")).where(F.col("__e").isNotNull())
    order = Window.partitionBy(*by).orderBy(time, *ties)
    past = F.lag(F.struct(F.col("__e").alias("e"), F.col(time).alias("t"))).over(order)
    dt = (F.col(time) - F.col("__p.t")) / 1000.0
    moved = points.withColumn("__p", past)
    moved = moved.withColumn("__area", F.when(dt > 0, F.col("__e") * dt)).withColumn("__slope", F.when(dt > 0, (F.col("__e") - F.col("__p.e")) / dt))
    last = F.max_by(F.struct(F.col("__e").alias("e"), F.col("__slope").alias("d")), F.when(F.coalesce(dt > 0, F.lit(True)), F.col(time)))
    grouped = moved.groupBy(*keys).agg(last.alias("__last"), F.coalesce(F.sum("__area"), F.lit(0.0)).alias("__sum"))
    output = kp * F.col("__last.e") + ki * F.col("__sum") + kd * F.coalesce(F.col("__last.d"), F.lit(0.0))
    return grouped.select(*keys, output.alias(out))


def slabs(points: DataFrame, keys: list[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """points (keys, time, v, ties) with ``i``, the row's number in its key from 1 on in order of time, and ``p``, the time and value of the row before.

    Each key's time span is cut into slabs that hold about ROWS rows where times are even, and only rows of one
    slab are sorted together; a row for each slab carries counts and last rows on.
    """
    from pyspark.sql import Window

    span = points.groupBy(*keys).agg(F.min(time).alias("__t0"), F.max(time).alias("__t1"), F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("__t1") - F.col("__t0") + 1) / F.ceil(F.col("n") / ROWS)))
    own = points.join(F.broadcast(span.select(*keys, "n", F.col("__t0").alias("t0"), width.alias("__w"))), keys)
    own = own.withColumn("__s", F.floor((F.col(time) - F.col("t0")) / F.col("__w")))
    order = Window.partitionBy(*keys, "__s").orderBy(time, *ties)
    here = F.struct(F.col(time).alias("t"), F.col("v"))
    own = own.withColumn("__i", F.row_number().over(order)).withColumn("__p", F.lag(here).over(order))
    sums = own.groupBy(*keys, "__s").agg(F.max("__i").cast("long").alias("__n"), F.max_by(here, "__i").alias("__last"))
    past = Window.partitionBy(*keys).orderBy("__s")
    before = F.coalesce(F.sum("__n").over(past.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    sums = sums.select(*keys, "__s", before.alias("__before"), F.lag("__last").over(past).alias("__end"))
    out = own.join(sums, [*keys, "__s"])
    return out.select(*points.columns, "n", "t0", (F.col("__before") + F.col("__i")).alias("i"), F.coalesce("__p", "__end").alias("p"))


def step_response(points: DataFrame, keys: list[str], time: str, first: float = 0.1, last: float = 0.1, ties: Sequence[str] = ()) -> DataFrame:
    """What ``model`` needs of each key's points (keys, time, v): count, levels, second time, and the 35 % and 85 % crossings in ms."""
    rows = slabs(points, keys, time, ties)
    # as int() of a product of doubles cuts
    head, tail = (F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") * F.lit(float(x)))) for x in (first, last))
    level = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.avg(F.when(F.col("i") <= head, F.col("v"))).alias("low"), F.avg(F.when(F.col("i") > F.col("n") - tail, F.col("v"))).alias("high"),
        F.max(F.when(F.col("i") == 2, F.col(time) - F.col("t0"))).alias("second"),
    )
    # every response rises from 0 to 1 in these
    rise = F.col("high") - F.col("low")
    scaled = lambda y: F.try_divide(y - F.col("low"), rise)
    moved = rows.select(*keys, time, "t0", "i", "p", "v").join(F.broadcast(level.select(*keys, "low", "high")), keys)
    moved = moved.select(*keys, "i", (F.col("p.t") - F.col("t0")).alias("pt"), (F.col(time) - F.col("t0")).alias("t"), scaled(F.col("p.v")).alias("px"), scaled(F.col("v")).alias("x"))

    def crossing(at: float) -> Column:
        made = F.col("pt") + (at - F.col("px")) / (F.col("x") - F.col("px")) * (F.col("t") - F.col("pt"))
        return F.min_by(made, F.when((F.col("px") < at) & (F.col("x") >= at), F.col("i")))

    crossings = moved.where("(px < 0.35 AND x >= 0.35) OR (px < 0.85 AND x >= 0.85)").groupBy(*keys).agg(crossing(0.35).alias("a"), crossing(0.85).alias("b"))
    return level.join(crossings, keys, "left")


def model(n: int, low: float, high: float, second: float, a: float | None, b: float | None, step: float = 1.0) -> tuple[float, float, float]:
    """(gain, time constant, dead time in ms) of a first-order process with dead time."""
    if n < LEAST_SAMPLES:
        raise ValueError(f"at least {LEAST_SAMPLES} samples are needed, not {n}")
    if abs(high - low) < 1e-12:
        raise ValueError("the series holds no step")
    for level, at in ((0.35, a), (0.85, b)):
        if at is None or at != at:
            raise ValueError(f"the response doesn't reach {level:.0%}")
    tau = (b - a) / (BEFORE_85 - BEFORE_35)
    theta = a - tau * BEFORE_35
    return (high - low) / step, tau, float(second) if theta < 0 else theta


def tune(gain: float, tau: float, theta: float, method: str = "zn", lam: float | None = None) -> tuple[float, float, float]:
    """(kp, ki, kd) by Ziegler-Nichols (zn), Cohen-Coon (cc) or internal model control (imc)."""
    if method == "zn":
        kp, ti, td = 1.2 * tau / (gain * theta), 2 * theta, theta / 2
    elif method == "cc":
        r = theta / tau
        kp, ti, td = (4 / 3 + r / 4) / (gain * r), theta * (32 + 6 * r) / (13 + 8 * r), 4 * theta / (11 + 2 * r)
    elif method == "imc":
        if lam is not None and lam <= 0:
            raise ValueError("lambda must be positive")
        ti = tau + theta / 2
        kp, td = ti / (gain * ((theta if lam is None else lam) + theta / 2)), tau * theta / (2 * tau + theta)
    else:
        raise ValueError(f"unknown tuning method {method!r}")
    return kp, kp / ti, kp * td


def pid_estimate(points: DataFrame, keys: list[str], time: str, out: str, method: str | None = None, step: float | None = None, first: float | None = None, last: float | None = None, lam: float | None = None, ties: Sequence[str] = ()) -> DataFrame:
    """One row for each key: JSON of kp, ki, kd; None arguments take their defaults.  Points (keys, time, v) stay in tasks of bounded size, and Python sees one row a key."""
    step, first, last = step or 1.0, 0.1 if first is None else first, 0.1 if last is None else last
    if not (0 < first < 0.5 and 0 < last < 0.5):
        raise ValueError("the fractions must lie in (0, 0.5)")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [tune(*model(*row, step), (method or "zn").lower(), lam) for row in part[["n", "low", "high", "second", "a", "b"]].itertuples(index=False)]
            part[out] = [json.dumps(dict(zip(("kp", "ki", "kd"), m, strict=True)), separators=(",", ":")) for m in made]
            yield part[[*keys, out]]

    found = step_response(points, keys, time, first, last, ties)
    kinds = dict(found.dtypes)
    return found.mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"`{out}` string"]))
