"""Run configuration shared by the matching passes and reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class MatchConfig:
    """Parameters of a reconciliation run.

    ``exact_window_days`` is the fixed +/- window of the exact pass (the
    reference hard-codes 2 days).  The tolerance pass reads its window and
    tolerance from the first active TOLERANCE rule; ``tolerance`` /
    ``tolerance_window_days`` only apply when no rules table is given.
    ``as_of`` replaces every ``now()`` so results are reproducible.
    """

    exact_window_days: int = 2
    tolerance: Decimal | None = None
    tolerance_window_days: int | None = None
    same_currency_batches: bool = False
    # rounds of mutual best per 1:1 pass (the reference runs one round)
    rounds: int = 1
    # classify leftovers into DUPLICATE / TIMING / AMOUNT_MISMATCH (J14) instead
    # of raising only MISSING_* exceptions (the reference's behaviour)
    classify_breaks: bool = False
    as_of: dt.datetime = field(default_factory=lambda: dt.datetime(2024, 2, 1, 0, 0, 0))
    run_id: int = 1
    batch_id: int | None = None
    run_date: dt.date | None = None
