"""Anomaly models that keep their scaling: fitted on one series, applied to later ones."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame

from relispan.operators import timeseries

METHODS = ("normal", "parallel", "approx", "incremental")


class AnomalyModel:
    """What scales series by parameters fitted before, and scores them; subclasses give ``profile``."""

    norm: str | None = "robust"

    def fit(self, series: DataFrame, other: DataFrame | None = None) -> AnomalyModel:
        """Fit the scaling on a series (series_id, i, v), and score it; ``other`` is an annotated series to compare with."""
        self.columns = series.select("series_id").distinct()
        self.scale = timeseries.fit_scale(series, self.norm)
        self.other = other
        self.history = series
        return self

    def evaluate(self, series: DataFrame) -> AnomalyModel:
        """Add later samples of the same series, scaled as the first ones."""
        now = series.select("series_id").distinct()
        if not now.join(self.columns, "series_id", "left_anti").isEmpty() or not self.columns.join(now, "series_id", "left_anti").isEmpty():
            raise ValueError("expected the series of the first samples")
        self.history = self.history.unionByName(series)
        return self

    def scaled(self) -> DataFrame:
        return timeseries.apply_scale(self.history, self.scale)

    def scores(self) -> DataFrame:
        raise NotImplementedError

    def anomalies(self, k: int) -> DataFrame:
        """The k largest scores of each series."""
        return timeseries.discords(self.scores(), k)


@dataclass
class MatrixProfileModel(AnomalyModel):
    """Distances of subsequences of m samples to their nearest neighbours."""

    m: int
    norm: str | None = "robust"
    method: str = "normal"
    znorm: bool = False
    zone_denominator: int = 4
    share: float = 0.1
    _first: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.method == "gpu":
            raise NotImplementedError("there are no graphics processors")
        if self.method not in METHODS:
            raise ValueError(f"unknown method {self.method!r}")
        self._first = {f.name: getattr(self, f.name) for f in fields(self) if f.name != "_first"}

    def get_params(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "_first"}

    def set_params(self, **params) -> MatrixProfileModel:
        if unknown := set(params) - set(self._first):
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        for k, v in params.items():
            setattr(self, k, v)
        return self

    def reset(self) -> MatrixProfileModel:
        """Back to the parameters it was made with, its norm included, and without history."""
        self.__dict__.pop("history", None)
        return self.set_params(**self._first)

    def evaluate(self, series: DataFrame) -> AnomalyModel:
        if self.method != "incremental":
            raise NotImplementedError(f"method {self.method!r} takes no further samples")
        return super().evaluate(series)

    def scores(self) -> DataFrame:
        other = None
        if self.other is not None:
            other = timeseries.apply_scale(self.other, self.scale)
        share = self.share if self.method == "approx" else 1.0
        return timeseries.matrix_profile(self.scaled(), self.m, other, self.znorm, self.zone_denominator, share)

    def intervals(self, threshold: Column) -> DataFrame:
        return timeseries.anomaly_intervals(self.scores(), self.m, threshold)
