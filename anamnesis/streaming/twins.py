"""Structured Streaming forms: ingestion, decaying edges, request limits, circuit breakers, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.memories import stored


def ingest(texts: DataFrame, append: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Store a stream of texts(id, content, source, ts) batch by batch; append gets the rows and the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        append(stored(batch, F.current_timestamp()), number)

    writer = texts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()


def edges(events: DataFrame, half_life_secs: float = 604_800.0, prune_below: float = 0.01) -> DataFrame:
    """Running edge weights of a stream of events(src, dst, strength, ts); an edge's state goes once it has faded."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, count, last = state.get if state.exists else (0.0, 0, 0.0)
        for part in parts:
            for ts, strength in sorted(zip(part["ts"], part["strength"], strict=True)):
                if ts >= last:
                    weight, last = weight * 0.5 ** ((ts - last) / half_life_secs) + strength, ts
                else:  # late: as if it had come in time
                    weight += strength * 0.5 ** ((last - ts) / half_life_secs)
                count += 1
        if weight < prune_below:
            state.remove()
        else:
            state.update((weight, count, last))
        yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "weight": [weight], "activation_count": [count], "last_activated": [last]})

    ends = events.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "strength", "ts")
    return ends.groupBy("src", "dst").applyInPandasWithState(fold, "src long, dst long, weight double, activation_count long, last_activated double", "weight double, count long, last double", "update", GroupStateTimeout.NoTimeout)


def limiter(requests: DataFrame, per_second: int) -> DataFrame:
    """client, second, n_allowed, n_refused of a stream of requests(client, ts)."""
    counts = requests.withWatermark("ts", "10 seconds").groupBy("client", F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select("client", F.col("window.start").alias("second"), F.least("n", F.lit(per_second)).alias("n_allowed"), F.greatest(F.col("n") - per_second, F.lit(0)).alias("n_refused"))


def decided(requests: DataFrame, per_second: int) -> DataFrame:
    """client, ts, allowed of a stream of requests(client, ts in seconds): of each second the first so many, as they come."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        second, used = state.get if state.exists else (-1, 0)
        for part in parts:
            out = []
            for ts in sorted(part["ts"]):
                if int(ts) > second:
                    second, used = int(ts), 0
                # a request of a second that is over finds it full
                allowed = int(ts) == second and used < per_second
                used += allowed
                out.append((key[0], ts, allowed))
            yield pd.DataFrame(out, columns=["client", "ts", "allowed"])
        state.update((second, used))

    return requests.groupBy("client").applyInPandasWithState(run, "client string, ts double, allowed boolean", "second long, used long", "append", GroupStateTimeout.NoTimeout)


def breaker(calls: DataFrame, failures: int = 5, cool_secs: float = 60.0) -> DataFrame:
    """provider, ts, before, state: what a breaker was when each call(provider, ts, ok) came, and what it is after it.

    closed; open after so many failures in a row; half-open for the first call when the pause after the last failure is over:
    if that call succeeds the breaker closes, else the pause begins anew.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failed, last = state.get if state.exists else (0, -1.0)
        for part in parts:
            out = []
            for ts, ok in sorted(zip(part["ts"], part["ok"], strict=True)):
                before = "closed" if failed < failures else "half-open" if ts - last >= cool_secs else "open"
                failed, last = (0, -1.0) if ok else (failed + 1, ts)
                out.append((key[0], ts, before, "closed" if failed < failures else "open"))
            yield pd.DataFrame(out, columns=["provider", "ts", "before", "state"])
        state.update((failed, last))

    return calls.groupBy("provider").applyInPandasWithState(run, "provider string, ts double, before string, state string", "failed long, last double", "append", GroupStateTimeout.NoTimeout)


def breaker_state(failed, last_failure, now, failures: int = 5, cool_secs: float = 60.0):
    """State of a breaker as an expression."""
    return F.when(failed < failures, "closed").when(now - last_failure >= cool_secs, "half-open").otherwise("open")


def periodic(ticks: DataFrame, maintain: Callable[[int], None], checkpoint: str, every: str = "300 seconds", available_now: bool = False):
    """Run maintain(batch number) for every micro-batch of a stream of ticks (a rate source, say), the first after one interval.
    A batch that is run again after a failure has the same number."""

    def each(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            maintain(number)

    writer = ticks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling or sliding windows, late rows dropped after the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
