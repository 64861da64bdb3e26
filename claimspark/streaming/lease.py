"""Leases as keyed state: who holds a capture, until when."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "id string, owner string, at timestamp, outcome string, lease_until timestamp"
#: As the fold gives them: times in microseconds, 0 for no lease.
_OUT = "id string, owner string, at long, outcome string, lease_until long"
_STATE = "owner string, until long"
#: A request without a time comes after all others.
_NEVER = (1 << 63) - 1


def _requests(frames: Iterator[pd.DataFrame]) -> list[tuple[str | None, int, bool]]:
    """(owner, at, done) of one capture in the order of their times, then owners."""
    rows = [r for f in frames for r in zip(f["owner"].tolist(), f["at"].tolist(), f["done"].tolist(), strict=True)]
    return sorted(rows, key=lambda r: (r[1], r[0] is None, r[0] or ""))


def leases(requests: DataFrame, minutes: int = 20) -> DataFrame:
    """(id, owner, at, outcome, lease_until) of a stream of requests (id, owner, at, done): claimed, refused, released or finished.

    The first request of a capture that nobody holds gets it for ``minutes``; until then others' are refused. Requests of one
    capture count in the order of their times, then owners; one without a time comes last and is refused unless the capture is
    finished. The holder's own request renews the lease, a request ``done`` ends it for good.

    Captures have a few requests each, so their states travel with the rows in batches, not one call at a time.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner, until = state.get if state.exists else (None, 0)
        out: dict[str, list] = {"id": [], "owner": [], "at": [], "outcome": [], "lease_until": []}
        for who, now, done in _requests(frames):
            if until < 0:
                outcome = "finished"
            elif now == _NEVER or (until > now and owner != who):
                outcome = "refused"
            elif done:
                owner, until, outcome = who, -1, "released"
            else:
                owner, until, outcome = who, now + minutes * 60_000_000, "claimed"
            for column, value in zip(out.values(), (key[0], who, now, outcome, until if outcome == "claimed" else 0), strict=True):
                column.append(value)
        state.update((owner, until))
        yield pd.DataFrame(out)

    rows = requests.select("id", "owner", F.coalesce(F.unix_micros("at"), F.lit(_NEVER)).alias("at"), F.coalesce("done", F.lit(False)).alias("done"))
    made = rows.groupBy("id").applyInPandasWithState(fold, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
    time = lambda c, none: F.timestamp_micros(F.nullif(F.col(c), F.lit(none))).alias(c)
    return made.select("id", "owner", time("at", _NEVER), "outcome", time("lease_until", 0))
