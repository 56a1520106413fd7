"""Column expressions over the last ``size`` rows of a series.

``window`` is an ordered window over one series (or one chunk of it); ``seq`` is the row's position.
Frames use plain sums, minima and maxima wherever a feature can be derived from them, since each
aggregate in a sliding frame is re-evaluated for every row of the frame.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

STATISTICAL = ("mean", "std", "variance", "skewness", "kurtosis", "rms", "peak_to_peak", "jerk", "energy")
VIBRATION = ("crest_factor", "impulse_factor", "clearance_factor", "shape_factor")
THERMAL = ("thermal_drift", "thermal_rate", "thermal_acceleration")

SKEW_ROWS = 3
KURTOSIS_ROWS = 4


@dataclass(frozen=True)
class Trailing:
    window: WindowSpec
    size: int
    seq: str = "seq"

    @property
    def frame(self) -> WindowSpec:
        return self.window.rowsBetween(-(self.size - 1), 0)

    @property
    def rows(self) -> Column:
        """Rows in the frame: the series has no nulls, so the position tells."""
        return F.least(F.col(self.seq) + 1, F.lit(self.size)).cast("double")

    def sums(self, v: Column, name: str) -> dict[str, Column]:
        """First-level aggregates of one signal, all over the same frame."""
        over = self.frame
        return {
            f"{name}__sum": F.sum(v).over(over),
            f"{name}__sq": F.sum(v * v).over(over),
            f"{name}__abs": F.sum(F.abs(v)).over(over),
            f"{name}__root": F.sum(F.sqrt(F.abs(v))).over(over),
            f"{name}__min": F.min(v).over(over),
            f"{name}__max": F.max(v).over(over),
            f"{name}__var": F.var_samp(v).over(over),
            f"{name}__prev": F.lag(v).over(self.window),
            f"{name}__prev2": F.lag(v, 2).over(self.window),
        }

    def deviations(self, v: Column, name: str) -> dict[str, Column]:
        """Powers of each row's deviation from the mean of its own frame."""
        d = v - F.col(f"{name}__sum") / self.rows
        seq = F.col(self.seq)
        return {
            f"{name}__d3": F.when(seq >= SKEW_ROWS - 1, d * d * d),
            f"{name}__d4": F.when(seq >= KURTOSIS_ROWS - 1, d * d * d * d),
        }

    def moments(self, name: str) -> dict[str, Column]:
        """Frame means of those powers; the first rows of the series have too few of them."""
        out = {}
        for power, least in (("d3", SKEW_ROWS), ("d4", KURTOSIS_ROWS)):
            count = F.least(F.col(self.seq) - (least - 2), F.lit(self.size))
            out[f"{name}__m{power}"] = F.when(count >= least, F.sum(f"{name}__{power}").over(self.frame) / count)
        return out

    def features(self, v: Column, name: str) -> dict[str, Column]:
        """Final features from the columns of ``sums`` and ``moments``."""

        def part(suffix: str) -> Column:
            return F.col(f"{name}__{suffix}")

        def ratio(top: Column, bottom: Column) -> Column:
            return F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(0.0))

        n = self.rows
        flat = part("min") == part("max")
        variance = F.when(flat, 0.0).otherwise(F.coalesce(part("var"), F.lit(0.0)))
        std = F.sqrt(variance)
        mean = part("sum") / n
        rms = F.sqrt(part("sq") / n)
        peak = F.greatest(F.abs(part("min")), F.abs(part("max")))
        step = F.coalesce(v - part("prev"), F.lit(0.0))
        before = F.coalesce(part("prev") - part("prev2"), F.lit(0.0))
        root_mean = part("root") / n
        sigma = F.nullif(std, F.lit(0.0))
        return {
            f"{name}_mean": mean,
            f"{name}_std": std,
            f"{name}_variance": variance,
            f"{name}_skewness": ratio(part("md3"), sigma * sigma * sigma),
            f"{name}_kurtosis": F.coalesce(F.try_divide(part("md4"), F.nullif(sigma * sigma * sigma * sigma, F.lit(0.0))) - 3.0, F.lit(0.0)),
            f"{name}_rms": rms,
            f"{name}_peak_to_peak": part("max") - part("min"),
            f"{name}_jerk": F.abs(step),
            f"{name}_energy": part("sq"),
            f"{name}_crest_factor": ratio(peak, rms),
            f"{name}_impulse_factor": ratio(peak, part("abs") / n),
            f"{name}_clearance_factor": ratio(peak, root_mean * root_mean),
            f"{name}_shape_factor": ratio(rms, part("abs") / n),
            f"{name}_thermal_drift": v - mean,
            f"{name}_thermal_rate": step,
            f"{name}_thermal_acceleration": F.when(F.col(self.seq) > 0, step - before).otherwise(0.0),
        }
