"""A parameter-grid simulation of treated populations with resistance.

For each host h: sensitive S and resistant R cells grow logistically towards a
common capacity; each active item's load V infects S by mass action, and
resistance appears at rate mu ** (1 + alpha (n - 1)) with n items against the
host.  Scenarios are independent: a task integrates some of them as one array.
Results are illustrative, never measurements.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Model:
    growth: float = 0.6
    capacity: float = 1e9
    adsorption: float = 1e-9
    burst: float = 50.0
    decay: float = 0.1
    dose: float = 1e7
    start: float = 1e6


def effective_rate(mu: float, alpha: float, n: int) -> float:
    """Rate of resistance against n items at once; 0 where nothing targets the host."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is a share")
    return mu ** (1 + alpha * (n - 1)) if n else 0.0


def integrate_many(a: np.ndarray, mu, cost, alpha, t_max: float, n_steps: int, model: Model = Model(), inner: int = 20) -> np.ndarray:
    """Trajectories of many scenarios at once: scenario x time x (sensitive, resistant, load), by RK4 with fixed inner steps.

    a: scenario x item x host susceptibilities; an item that a scenario lacks has only zeros and no load.
    """
    size, items, hosts = a.shape
    n = (a >= 0.5).sum(1)
    rate = np.array([[effective_rate(float(m), float(x), int(k)) for k in row] for m, x, row in zip(mu, alpha, n)]).reshape(size, hosts)
    keep = (1 - np.asarray(cost, float))[:, None]
    dose = np.where(a.any(2), model.dose, 0.0)
    x = np.concatenate([np.full((size, hosts), model.start), np.zeros((size, hosts)), dose], 1)

    def slope(x):
        x = np.maximum(x, 0)
        s, r, v = x[:, :hosts], x[:, hosts : 2 * hosts], x[:, 2 * hosts :]
        room = 1 - (s + r).sum(1, keepdims=True) / model.capacity
        hit = model.adsorption * s * (a * v[:, :, None]).sum(1)
        born = model.growth * s * room
        new = rate * np.maximum(born, 0)
        dv = model.burst * model.adsorption * (a * s[:, None, :]).sum(2) * v - model.decay * v
        return np.concatenate([born - new - hit, model.growth * keep * r * room + new, dv], 1)

    grid, out = np.linspace(0, t_max, n_steps), np.empty((size, n_steps, 3))
    for k in range(n_steps):
        if k:
            h = (grid[k] - grid[k - 1]) / inner
            for _ in range(inner):
                k1 = slope(x)
                k2 = slope(x + h / 2 * k1)
                k3 = slope(x + h / 2 * k2)
                k4 = slope(x + h * k3)
                # stiff bursts overshoot: populations stay finite and non-negative
                x = np.clip(np.nan_to_num(x + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), posinf=1e15), 0, 1e15)
        out[:, k] = np.stack([x[:, :hosts].sum(1), x[:, hosts : 2 * hosts].sum(1), x[:, 2 * hosts :].sum(1)], 1)
    return out


def integrate(a: np.ndarray, mu: float, cost: float, alpha: float, t_max: float, n_steps: int, model: Model = Model(), inner: int = 20) -> pd.DataFrame:
    """One trajectory: totals of sensitive and resistant cells and load on an even grid."""
    x = integrate_many(a[None], [mu], [cost], [alpha], t_max, n_steps, model, inner)[0]
    return pd.DataFrame({"t": np.linspace(0, t_max, n_steps), "sensitive": x[:, 0], "resistant": x[:, 1], "load": x[:, 2]})


#: Scenarios that one task integrates together.
TOGETHER = 64


def run_grid(scenarios: DataFrame, t_max: float = 48.0, n_steps: int = 97) -> DataFrame:
    """scenarios: scenario, mu, cost, alpha, and n_items with n_hosts (all fully susceptible) or a (items x hosts).  One trajectory each."""
    given = "a" in scenarios.columns

    def together(batches):
        for pdf in batches:
            for at in range(0, len(pdf), TOGETHER):
                part = pdf.iloc[at : at + TOGETHER]
                one = [np.array(x.tolist(), float).reshape(len(x), -1) for x in part.a] if given else [np.ones((int(i), int(h))) for i, h in zip(part.n_items, part.n_hosts)]
                a = np.zeros((len(part), max(max(x.shape[0] for x in one), 1), max(x.shape[1] for x in one)))
                for k, x in enumerate(one):
                    a[k, : x.shape[0], : x.shape[1]] = x
                got = integrate_many(a, part.mu, part.cost, part.alpha, t_max, n_steps)
                # hosts that only pad have grown by themselves: scenarios of one width share a batch
                yield pd.DataFrame({"scenario": np.repeat(part.scenario.to_numpy(), n_steps), "t": np.tile(np.linspace(0, t_max, n_steps), len(part)), "sensitive": got[:, :, 0].ravel(), "resistant": got[:, :, 1].ravel(), "load": got[:, :, 2].ravel()})

    def by_width(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(together([pdf.sort_values("scenario")])))

    width = F.size(F.get("a", F.lit(0))) if given else F.col("n_hosts")
    dealt = scenarios.withColumns({"_w": width, "_g": F.pmod(F.xxhash64("scenario"), F.greatest(F.lit(1), F.ceil(F.lit(scenarios.count()) / TOGETHER))).cast("int")})
    return dealt.groupBy("_w", "_g").applyInPandas(by_width, "scenario long, t double, sensitive double, resistant double, load double")


def trajectory_metrics(t: DataFrame, by=("scenario",)) -> DataFrame:
    """Nadir, end, log10 drop, resistant share, time to 99 % suppression and rebound.

    A row without a total is passed over; a start of 0 has a drop of minus infinity.
    """
    x = t.withColumn("total", F.col("sensitive") + F.col("resistant"))
    x = x.withColumn("t", F.when(F.col("total").isNotNull(), F.col("t")))  # no start and no end
    g = x.groupBy(*by).agg(
        F.min_by("total", "t").alias("start"), F.min("total").alias("nadir"), F.max_by("total", "t").alias("end"), F.max_by("resistant", "t").alias("end_resistant"),
        F.collect_list(F.struct("t", "total")).alias("_x"),
    )
    low = F.array_min(F.transform(F.filter("_x", lambda p: p["total"] <= 0.01 * F.col("start")), lambda p: p["t"]))
    drop = F.col("start") / F.greatest("nadir", F.lit(1.0))
    # Spark's log10 is null at 0 and below
    drop = F.when(drop == 0, float("-inf")).when(drop < 0, float("nan")).otherwise(F.log10(drop))
    return g.select(
        *by, "start", "nadir", "end", drop.alias("log10_drop"),
        F.when(F.col("end") > 0, F.col("end_resistant") / F.col("end")).otherwise(0.0).alias("resistant_fraction"), low.alias("t99"),
        ((F.col("end") > 0.1 * F.col("start")) & (F.col("nadir") < 0.1 * F.col("start"))).alias("rebound"),
    )
