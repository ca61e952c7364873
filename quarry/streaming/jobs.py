"""The life of jobs as a stateful stream: requests arrive as rows, each gets an answer, and the state of a job outlives the stream.

A job's state is one small row in Spark's state store, partitioned by job and written with each batch, so a restart goes on where the last
committed batch ended and nothing that was written is read again. A timer ends jobs that have gone silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The states, and those that end a job.
LIVE, FINAL = ("queued", "running"), ("completed", "cancelled", "failed")
#: Requests: job, order, what is asked, the rows it promises or brings.
REQUESTS = "job string, seq long, op string, n long"
ANSWERS = "job string, seq long, op string, answer string, state string, done long, total long"
STATE = "state string, done long, total long"


def step(held: tuple[str, int, int] | None, op: str, n: int) -> tuple[str, tuple[str, int, int] | None]:
    """The answer to a request, and the job after it.

    ``submit`` makes a job of ``n`` rows; a cancelled one is queued again and keeps its rows. ``start`` runs a queued job, ``rows`` brings ``n``
    rows to a running one, which is completed once all are there. ``fail`` and ``cancel`` end a live job; ``results`` are there for an
    ended one. ``status`` asks for nothing. Anything else is a bad request; what the state does not allow is a conflict.
    """
    if op not in ("submit", "start", "rows", "fail", "cancel", "results", "status"):
        return "bad_request", held
    if held is None:
        return ("ok", ("queued", 0, n)) if op == "submit" and n > 0 else ("bad_request" if op == "submit" else "not_found", None)
    state, done, total = held
    if op == "status":
        return "ok", held
    if op == "submit" and state == "cancelled":
        return "ok", ("queued", done, total)
    if op == "start" and state == "queued":
        return "ok", ("running", done, total)
    if op == "rows" and state == "running" and n > 0:
        done = min(done + n, total)
        return "ok", ("completed" if done == total else "running", done, total)
    if op in ("fail", "cancel") and state in LIVE:
        return "ok", ("failed" if op == "fail" else "cancelled", done, total)
    if op == "results" and state in FINAL:
        return "ok", held
    return "conflict", held


def answers(requests: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """A stream of ``REQUESTS`` as a stream of ``ANSWERS``; a batch's requests of one job are taken by ``seq``.

    With ``patience_ms``, a live job without a request for so long (by the clock) is cancelled, which is answered under ``timeout``. Null
    jobs are bad requests without a state; a null ``n`` is none.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else None
        if held.hasTimedOut:
            if now and now[0] in LIVE:
                now = ("cancelled", now[1], now[2])
                held.update(now)
                yield pd.DataFrame([(key[0], None, "timeout", "ok", *now)], columns=[f.split()[0] for f in ANSWERS.split(", ")])
            return
        asked = pd.concat(list(batches)).sort_values("seq", kind="stable")
        out = []
        for seq, op, n in zip(asked["seq"], asked["op"], asked["n"], strict=True):
            if key[0] is None:
                out.append((None, seq, op, "bad_request", None, None, None))
                continue
            answer, now = step(now, op, 0 if pd.isna(n) else int(n))
            out.append((key[0], seq, op, answer, *(now or (None, None, None))))
        if now:
            held.update(now)
            if patience_ms and now[0] in LIVE:
                held.setTimeoutDuration(patience_ms)
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in ANSWERS.split(", ")])
        yield frame.astype({c: "Int64" for c in ("seq", "done", "total")})

    timer = GroupStateTimeout.ProcessingTimeTimeout if patience_ms else GroupStateTimeout.NoTimeout
    return requests.groupBy("job").applyInPandasWithState(advance, ANSWERS, STATE, "append", timer)


def serve(requests: DataFrame, target: str, checkpoint: str, patience_ms: int | None = None, available_now: bool = True):
    """Starts the stream that answers requests into a Parquet folder; with ``available_now`` it ends with what is there."""
    writer = answers(requests, patience_ms).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest(given: DataFrame) -> DataFrame:
    """``(job, state, done, total)`` after the last answer of each job; a timeout has no ``seq`` and is the last of its job."""
    last = F.max_by(F.struct("state", "done", "total"), F.coalesce("seq", F.lit(2**63 - 1)))
    return given.where("job is not null and state is not null").groupBy("job").agg(last.alias("m")).select("job", "m.*")
