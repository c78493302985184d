"""Dataset profile and decision policies carried beside a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Reserved columns of a split table.
SOURCE_ROW_ID = "__source_row_id"
SPLIT_ROLE = "__split_role"
PROTOCOL_ID = "__split_protocol_id"
SPLIT_COLUMNS = (SOURCE_ROW_ID, SPLIT_ROLE, PROTOCOL_ID)


class ContractError(ValueError):
    """Input data break a declared contract."""


@dataclass(frozen=True)
class Profile:
    """Roles of the columns of a sensor table."""

    dataset_id: str
    label: str
    negative: object
    positive: object
    timestamp: str | None = None
    timestamp_format: str | None = None
    ids: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    feature_prefix: str | None = None
    missing_threshold: float = 0.5
    drop_constant: bool = True

    def metadata_columns(self) -> set[str]:
        roles = {self.label, *self.ids, *self.groups, *self.excluded, *SPLIT_COLUMNS}
        return roles | ({self.timestamp} if self.timestamp else set())

    def features(self, columns: list[str]) -> list[str]:
        """Feature columns in table order, or an error when a role column is missing."""
        if len(set(columns)) != len(columns):
            raise ContractError("duplicate column names")
        needed = [self.label, *([self.timestamp] if self.timestamp else []),
                  *self.ids, *self.groups, *self.excluded]
        missing = [c for c in needed if c not in columns]
        if missing:
            raise ContractError(f"role columns missing from the table: {missing}")
        outside = self.metadata_columns()
        found = [c for c in columns if c not in outside and (
            self.feature_prefix is None or c.startswith(self.feature_prefix) or c in self.categorical)]
        absent = [c for c in self.categorical if c not in found]
        if absent:
            raise ContractError(f"declared categorical columns are not features: {absent}")
        if not found:
            raise ContractError("the profile selects no feature column")
        return found

    def numeric_features(self, columns: list[str]) -> list[str]:
        return [c for c in self.features(columns) if c not in self.categorical]


@dataclass(frozen=True)
class ThresholdPolicy:
    min_recall: float = 0.8
    max_reinspection_ratio: float = 0.4


@dataclass(frozen=True)
class ReductionPolicy:
    comparison_pairs: tuple[tuple[str, str], ...] = ()
    max_sensor_count: int = 20
    target_ap_loss_ratio: float = 0.2
    max_ap_loss_ratio: float = 0.3


@dataclass(frozen=True)
class Evaluation:
    """Settings shared by model comparisons."""

    default_threshold: float = 0.5
    pca_variance: float = 0.9
    seed: int = 42
    n_splits: int = 5
    n_repeats: int = 5
    policy: ThresholdPolicy = field(default_factory=ThresholdPolicy)


def label_violations(df: DataFrame, profile: Profile) -> DataFrame:
    """One row with the counts of null labels and labels outside the two declared values."""
    label = F.col(profile.label)
    allowed = label.isin(profile.negative, profile.positive)
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(label.isNull()).alias("null_labels"),
        F.count_if(label.isNotNull() & ~allowed).alias("unknown_labels"),
        F.count_if(label == F.lit(profile.negative)).alias("negative_rows"),
        F.count_if(label == F.lit(profile.positive)).alias("positive_rows"),
    )


def validate_frame(df: DataFrame, profile: Profile) -> list[str]:
    """Check types and label values; return the feature columns."""
    features = profile.features(df.columns)
    wrong = [f.name for f in df.schema.fields
             if f.name in features and f.name not in profile.categorical
             and not isinstance(f.dataType, T.NumericType)]
    if wrong:
        raise ContractError(f"non-numeric features must be declared categorical: {wrong}")
    found = label_violations(df, profile).first()
    if found.null_labels or found.unknown_labels:
        raise ContractError(f"{found.null_labels} null and {found.unknown_labels} unknown labels")
    return features


def feature_frame(df: DataFrame, profile: Profile, train_features: list[str] | None = None) -> DataFrame:
    """Features in Train order followed by the label."""
    features = profile.features(df.columns)
    if train_features is not None:
        if set(train_features) != set(features):
            raise ContractError("feature columns differ from those of Train")
        features = list(train_features)
    return df.select(*features, profile.label)
