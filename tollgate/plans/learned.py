"""Registered queries that fit models: rows only, as another library's fit would differ."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits
from . import models
from .core import CUT, evts, query


def _stage(s, d, kind, **settings):
    e = evts(s, d).withColumns({"sender_account": F.col("sender_id"), "receiver_account": F.col("receiver_id")})
    rings, accounts = splits.rings_of(e), splits.ring_accounts_of(e)
    _, out = models.train_stage(e, CUT, splits.ring_sides(rings, accounts, CUT), kind, **settings)
    return out.select("txn_id", "event_date", "is_laundering", F.round("score", 6).alias("score"))


@query()
def model_lr_scores(s, d):
    return _stage(s, d, "lr")


@query()
def model_gbt_scores(s, d):
    """Boosted trees with the settings of ``models.GBT``."""
    return _stage(s, d, "gbt")
