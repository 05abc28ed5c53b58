"""Fitted statistics, kept as a small table and applied to any number of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "ord int, feature string, median double, mean double, std double, kept boolean, drop_reason string"


@dataclass
class Artifacts:
    """Feature order, medians, means and standard deviations, and why columns were dropped."""

    features: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)

    def to_table(self, spark: SparkSession) -> DataFrame:
        kept = [
            (k, f, self.medians.get(f), self.means.get(f), self.stds.get(f), True, None)
            for k, f in enumerate(self.features)
        ]
        gone = [
            (len(kept) + k, f, self.medians.get(f), None, None, False, why)
            for k, (f, why) in enumerate(self.dropped.items())
        ]
        return spark.createDataFrame(kept + gone, SCHEMA)

    @classmethod
    def from_table(cls, table: DataFrame) -> Artifacts:
        art = cls()
        for r in table.orderBy("ord").collect():  # one row per feature
            if r["median"] is not None:
                art.medians[r["feature"]] = r["median"]
            if r["kept"]:
                art.features.append(r["feature"])
                if r["mean"] is not None:
                    art.means[r["feature"]], art.stds[r["feature"]] = r["mean"], r["std"]
            else:
                art.dropped[r["feature"]] = r["drop_reason"]
        return art

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_table(spark).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Artifacts:
        return cls.from_table(spark.read.parquet(path))


def require_features(needed: list[str], available: list[str]) -> None:
    """Stop with the first missing names when a model's features are not all there."""
    missing = [c for c in needed if c not in set(available)]
    if missing:
        raise ValueError(f"{len(missing)} features are missing, e.g. {', '.join(missing[:10])}")


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    numeric = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return [c for c, t in df.dtypes if t.startswith(numeric) and c not in exclude]


