"""Which columns play which role. Every operator takes these names as parameters; the
account presets below are only one value of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Column names, groups, orders and labels that results depend on.
ID_COL = "customerID"
TARGET_COL = "Churn"
POSITIVE = "Yes"
NEGATIVE = "No"
NUMERIC = ("tenure", "MonthlyCharges", "TotalCharges")
BINARY = ("gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "PaperlessBilling")
CATEGORICAL = (
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaymentMethod",
)
CATEGORICAL_ALL = (
    "gender", "SeniorCitizen", "Partner", "Dependents", "PhoneService", "MultipleLines",
    "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
    "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod",
)
REQUIRED_COLS = ("customerID", "Churn", "TotalCharges", "tenure")


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of one modelling table.

    ``*_prefix`` names the group in transformed feature names (``prefix__column``);
    ``drop_if_binary`` keeps one indicator for a column with exactly two categories.
    """

    numeric: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    id_cols: tuple[str, ...] = ()
    target: str = "label"
    positive: str = "1"
    negative: str = "0"
    numeric_prefix: str = "numeric"
    binary_prefix: str = "binary"
    categorical_prefix: str = "categorical"
    drop_if_binary: bool = False

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.binary + self.categorical

    @property
    def groups(self) -> tuple[tuple[str, str], ...]:
        """(group prefix, column) in output order."""
        return (
            tuple((self.numeric_prefix, c) for c in self.numeric)
            + tuple((self.binary_prefix, c) for c in self.binary)
            + tuple((self.categorical_prefix, c) for c in self.categorical)
        )


#: Two groups, every category kept as an indicator.
BASELINE = FeatureSpec(
    numeric=NUMERIC, categorical=CATEGORICAL_ALL, id_cols=(ID_COL,), target=TARGET_COL,
    positive=POSITIVE, negative=NEGATIVE, numeric_prefix="num", categorical_prefix="cat",
)

#: Three groups, two-valued categoricals kept as one indicator.
GROUPED = FeatureSpec(
    numeric=NUMERIC, binary=BINARY, categorical=CATEGORICAL, id_cols=(ID_COL,),
    target=TARGET_COL, positive=POSITIVE, negative=NEGATIVE, drop_if_binary=True,
)

_TYPES = {"tenure": T.IntegerType(), "MonthlyCharges": T.DoubleType(), "SeniorCitizen": T.IntegerType()}

#: Raw snapshot columns in file order. TotalCharges is text: it holds blanks.
ACCOUNT_COLUMNS = (
    "customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure", "PhoneService",
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "Contract", "PaperlessBilling",
    "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn",
)

ACCOUNT_SCHEMA = T.StructType(
    [T.StructField(c, _TYPES.get(c, T.StringType())) for c in ACCOUNT_COLUMNS]
)
