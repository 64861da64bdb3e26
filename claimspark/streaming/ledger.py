"""Work queues as streams: at-least-once delivery, a ledger of what is done, failure counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from claimspark.operators.reconcile import best_per_key, pending
from claimspark.operators.runs import folded
from claimspark.sources.shared import kept
from claimspark.sources.store import Store

LEDGER = "idempotency_key string, status string, attempts long"
STATE = (
    "source_id string, last_observation string, last_complete_observation string, last_normalised string, last_complete_normalised string, last_run_at string, last_success_at string, "
    "last_failure_at string, consecutive_failures long"
)


def consume(stream: DataFrame, store: Store, work: Callable[[DataFrame], DataFrame], checkpoint: str, table: str = "ledger", most: int = 3) -> StreamingQuery:
    """Run ``work`` on each micro-batch's items that aren't done: it returns (idempotency_key, status, ...).

    An item appears once a batch, however often it was sent: the least of its rows. ``work`` is evaluated once a batch. The outcomes
    and the batch's number are one commit of the store, so a batch that is run again after it changes nothing; after ``most`` attempts a failed item is
    dead and no longer tried.
    """

    def batch(items: DataFrame, number: int) -> None:
        with store.transaction() as change:
            if not change.once(checkpoint, number):
                change.writer = None
                return
            ledger = change.read(table, LEDGER)
            todo = pending(best_per_key(items, ["idempotency_key"], F.struct(F.lit(0)), F.struct(*map(F.col, items.columns))), ledger)
            todo = todo.join(ledger.where("status = 'dead'"), "idempotency_key", "left_anti")
            done = kept(work(todo).select("idempotency_key", "status"), "ledger")
            done = done.join(ledger.select("idempotency_key", "attempts"), "idempotency_key", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0)) + 1)
            done = done.withColumn("status", F.when((F.col("status") == "failed") & (F.col("attempts") >= most), "dead").otherwise(F.col("status")))
            change.upsert(table, done, ["idempotency_key"], LEDGER)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def track_runs(stream: DataFrame, store: Store, checkpoint: str, table: str = "source_state") -> StreamingQuery:
    """Keep each source's state after its runs (source_id, started_at, ok, complete, observation, normalised), batch by batch.

    Within a batch a source's runs count in the order of their times, in one pass. A batch that is run again after its commit
    changes nothing.
    """

    def batch(runs: DataFrame, number: int) -> None:
        with store.transaction() as change:
            if not change.once(checkpoint, number):
                change.writer = None
                return
            runs = kept(runs, "runs")
            state = change.read(table, STATE)
            touched = state.join(runs.select("source_id").distinct(), "source_id", "left_semi")
            change.upsert(table, folded(touched, runs), ["source_id"], STATE)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
