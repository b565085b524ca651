"""Schemas, constants and errors that every stage agrees on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Columns of a raw transfer by position; fixed values. The raw header repeats a name, so names never come from it.
COLUMNS = (
    ("event_time", T.TimestampNTZType()),
    ("sender_bank", T.StringType()),
    ("sender_account", T.StringType()),
    ("receiver_bank", T.StringType()),
    ("receiver_account", T.StringType()),
    ("amount_received", T.DoubleType()),
    ("receiving_currency", T.StringType()),
    ("amount_paid", T.DoubleType()),
    ("payment_currency", T.StringType()),
    ("payment_format", T.StringType()),
    ("is_laundering", T.ByteType()),
)
RAW_SCHEMA = T.StructType([T.StructField(n, t) for n, t in COLUMNS])
#: The one header line that is accepted; fixed value.
HEADER = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering"
#: Format of a raw transfer's time; fixed value.
TIME_FORMAT = "yyyy/MM/dd HH:mm"

#: Ring shapes; fixed values.
TYPOLOGIES = ("FAN-OUT", "FAN-IN", "CYCLE", "BIPARTITE", "STACK", "SCATTER-GATHER", "GATHER-SCATTER", "RANDOM")
#: Review slots a day; fixed values.
BUDGETS = (10, 25, 50, 100, 200, 500, 1000)
#: Trailing windows of the history features, in seconds, and the exclusion of the present minute; fixed values.
WINDOWS = {"1d": 86_400, "7d": 604_800, "30d": 2_592_000}
MINUTE = 60
#: Share of the median daily volume under which a day counts as thin.
COLLAPSE = 0.01
#: Ranks that a replay bundle keeps of each day.
BUNDLE_CAP = 1000

#: Names of the features, in the order of the table; fixed values.
TXN_FEATURES = (
    "log_amount_paid", "log_amount_received", "fx_ratio", "currency_mismatch", "amount_roundness", "hour", "dayofweek",
    "is_weekend", "is_self_transfer", "is_cross_bank", "payment_format_code", "payment_currency_code",
)
HISTORY = (
    "n_1d", "n_7d", "n_30d", "mean_amt_7d", "std_amt_7d", "max_amt_30d", "n_out_7d", "secs_since_prev", "secs_since_prev_cp",
    "n_in_7d", "out_share_7d", "n_new_cp_7d", "new_cp_rate_7d", "n_distinct_cp_ever",
)
MODEL_HISTORY = ("n_1d", "n_7d", "n_30d", "mean_amt_7d", "std_amt_7d", "max_amt_30d", "n_out_7d", "secs_since_prev", "secs_since_prev_cp", "amt_vs_hist")
FEATURES = (*TXN_FEATURES, *(f"{s}_{f}" for s in "sr" for f in MODEL_HISTORY))


class TollgateError(Exception):
    """Any refusal of this engine; the run's numbers would be wrong."""


class ContractError(TollgateError):
    """Input that breaks the declared schema or identity."""


class PatternError(TollgateError):
    """A malformed ring block."""


class LeakageError(TollgateError):
    """A split that shares rings, accounts or time between train and test."""


class LeakNotDetected(TollgateError):
    """The label-derived control did not separate from its placebo."""


class DriftError(TollgateError):
    """A generated drift that is not the one asked for."""


class MetricError(TollgateError):
    """Scores or labels on which a metric is undefined."""


def require(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    """The frame itself, once it has all ``columns``."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{what} has no column {', '.join(missing)}")
    return df


def check(ok: bool, error: type[TollgateError], message: str) -> None:
    if not ok:
        raise error(message)
