"""Profiles of sellers, asked once for each name; only figures leave this module."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from skeinworks.operators.enrich import asked

FACTS = "account_age_days bigint, recent_sales bigint"


def figures(answer: str | bytes, now: datetime) -> tuple[int | None, int | None] | None:
    """(days since registration, positive feedback of the last 30 days) of a profile; each is None where it isn't stated.

    None for an answer without success or profile; a registration in the
    future states nothing.
    """
    got = json.loads(answer)
    user = got.get("User")
    if str(got.get("Ack", "")).lower() != "success" or not user:
        return None
    days = None
    try:
        since = datetime.fromisoformat(user.get("RegistrationDate") or "")
        days = (now - (since if since.tzinfo else since.replace(tzinfo=UTC))).days
    except ValueError:
        pass
    periods = ((user.get("FeedbackHistory") or {}).get("PositiveFeedbackPeriodArray") or {}).get("FeedbackPeriod") or []
    sales = next((p.get("Count") for p in periods if p.get("PeriodInDays") == 30), None)
    return days if days is not None and days >= 0 else None, sales


def profiles(rows: DataFrame, seller: str, get: Callable[[str], str | bytes], now: datetime) -> DataFrame:
    """(seller, account_age_days, recent_sales): what marketplace.mapped() takes; ``get`` is called once for each name, and a failing call leaves its seller out."""

    def ask(names: list) -> list:
        out = []
        for name in names:
            try:
                out.append(figures(get(name), now))
            except Exception:  # noqa: BLE001  a seller without a profile is no error
                out.append(None)
        return out

    return asked(rows, seller, ask, FACTS)
