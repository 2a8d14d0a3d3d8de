"""Leitner boxes kept up to date from a stream of attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUT, STATE = "user_id long, mcq long, reviews long, box long", "reviews long, box long"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    reviews, box = state.get if state.exists else (0, 0)
    rows = pd.concat(list(batches)).sort_values(["ts", "attempt_id"])
    for ok in rows["ok"]:
        reviews, box = reviews + 1, min(box + 1, 5) if ok else 1
    state.update((reviews, box))
    yield pd.DataFrame({"user_id": [key[0]], "mcq": [key[1]], "reviews": [reviews], "box": [box]})


def boxes(attempts: DataFrame) -> DataFrame:
    """A streaming ``attempts`` (user_id, mcq, ts, attempt_id, ok) -> the box of each card as batches arrive. Only two numbers a card are kept. Attempts are put in order inside a batch; one that comes in a later batch than a younger one counts when it comes."""
    return attempts.groupBy("user_id", "mcq").applyInPandasWithState(_advance, OUT, STATE, "update", "NoTimeout")
