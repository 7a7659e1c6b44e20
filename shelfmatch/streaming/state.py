"""Keyed state of the feedback and job streams: what is settled, what still waits, when it is forgotten."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from shelfmatch.constants import JOB_RETENTION_SECONDS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Value, list and timer state need the store that keeps its data on disk."""
    if spark.conf.get(PROVIDER) != ROCKS:
        spark.conf.set(PROVIDER, ROCKS)


def _known(value: Any) -> Any:
    return None if value is None or value is pd.NaT or value != value else value


class Vote(NamedTuple):
    seq: int
    image_sha256: str
    predicted_slug: str
    is_correct: bool
    correct_slug: str | None
    ts: Any


VOTE = "seq long, image_sha256 string, predicted_slug string, is_correct boolean, correct_slug string, ts timestamp"


class Row(NamedTuple):
    """A job's feedback after its votes up to ``seq``."""

    image_sha256: str
    predicted_slug: str
    is_correct: bool
    correct_slug: str | None
    review_status: str
    embedding_state: str
    label_revision: int
    retired_label: str | None
    seq: int
    created_at: Any
    updated_at: Any


ROW = (
    "image_sha256 string, predicted_slug string, is_correct boolean, correct_slug string, review_status string, "
    "embedding_state string, label_revision int, retired_label string, seq long, created_at timestamp, updated_at timestamp"
)
FEEDBACK_OUT = f"job_id string, {ROW}"


def fold_vote(row: Row | None, vote: Vote) -> Row:
    """The feedback rule: a new label queues the photo again, a changed vote needs review again."""
    if row is None:
        state = "queued" if vote.correct_slug else "unlabeled"
        return Row(vote.image_sha256, vote.predicted_slug, vote.is_correct, vote.correct_slug, "pending", state, 0, None, vote.seq, vote.ts, vote.ts)
    relabelled = row.correct_slug != vote.correct_slug
    return row._replace(
        is_correct=vote.is_correct, correct_slug=vote.correct_slug, seq=vote.seq, updated_at=vote.ts,
        review_status="pending" if relabelled or row.is_correct != vote.is_correct else row.review_status,
        embedding_state="queued" if relabelled or row.embedding_state == "failed" else row.embedding_state,
        label_revision=row.label_revision + relabelled,
        retired_label=(row.correct_slug or row.retired_label) if relabelled else row.retired_label,
    )


class VoteFolding(StatefulProcessor):
    """Votes wait in a list until no earlier one can come, then they settle into one row.

    Each micro-batch gives the row that all votes so far make: the settled one with the waiting ones
    folded on top. A vote at or before the last settled one, or one that waits already, changes
    nothing, so replays and any order inside the lateness give what the batch rule gives.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", ROW)
        self.waiting = handle.getListState("waiting", VOTE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        row = Row(*self.settled.get()) if self.settled.exists() else None
        last = row.seq if row else None
        held = {v[0]: Vote(*v) for v in self.waiting.get()} if self.waiting.exists() else {}
        for batch in rows:
            for values in batch[list(Vote._fields)].itertuples(index=False, name=None):
                vote = Vote(*map(_known, values))
                if last is None or vote.seq > last:
                    held.setdefault(vote.seq, vote)
        until = pd.Timestamp(max(0, timerValues.getCurrentWatermarkInMs()), unit="ms")
        order = sorted(held)
        while order and pd.Timestamp(held[order[0]].ts).tz_localize(None) <= until:
            row = fold_vote(row, held.pop(order.pop(0)))
            last = row.seq
        if row is not None:
            self.settled.update(tuple(row))
        if order:
            self.waiting.put([tuple(held[seq]) for seq in order])
        else:
            self.waiting.clear()
        for seq in order:
            row = fold_vote(row, held[seq])
        if row is not None:
            yield pd.DataFrame([{"job_id": key[0], **row._asdict()}])

    def close(self) -> None:
        pass


def feedback_stream(votes: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Current feedback row of every job that got votes, in update mode.

    ``votes``: job_id, image_sha256, predicted_slug, is_correct, correct_slug, seq, ts. ``seq`` and
    ``ts`` rise together; a vote that comes more than ``lateness`` after a later one is dropped.
    State per job is one row and the votes of the last ``lateness``. ``operators.feedback.fold_votes``
    is the same rule over a whole table.
    """
    keep_state_on_disk(votes.sparkSession)
    return votes.withWatermark("ts", lateness).groupBy("job_id").transformWithStateInPandas(
        VoteFolding(), FEEDBACK_OUT, "Update", "EventTime")


STAGE_STATE = {"done": "done", "failed": "failed", "queued": "queued"}
FINISHED = ("done", "failed")
JOB_OUT = "job_id string, seq long, state string, stage string, progress double, elapsed_ms long, updated_at timestamp"
JOB_STATE = "state string, progress double, seq long, created_at timestamp, updated_at timestamp"
#: Rows of one answer; a job with many events gives several.
ANSWER = 10_000


class JobStates(StatefulProcessor):
    """The state after every event of a job, until it is forgotten some time after it finished.

    A timer forgets a finished job and says so. A mark with a time to live stays behind it, so that
    events which are replayed within the same time do not bring the job back.
    """

    def __init__(self, retention_ms: int) -> None:
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", JOB_STATE)
        self.gone = handle.getValueState("gone", "seq long", self.retention_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        if self.gone.exists():
            for _ in rows:
                pass
            return
        name, progress, last, created, updated = self.job.get() if self.job.exists() else ("queued", 0.0, None, None, None)
        was_finished = name in FINISHED
        # Four numbers an event are held, whatever else its rows carry.
        parts = [(b["seq"].to_numpy(), b["ts"].to_numpy("datetime64[us]"), b["stage"].to_numpy(), b["progress"].to_numpy(float)) for b in rows]
        seq, ts, stage, value = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((seq, ts))
        again = np.r_[False, (np.diff(seq[order]) == 0) & (np.diff(ts[order]) == np.timedelta64(0, "us"))]
        if last is not None:
            before = np.datetime64(pd.Timestamp(updated).tz_localize(None), "us")
            again |= (ts[order] < before) | ((ts[order] == before) & (seq[order] <= last))
        order = order[~again]
        if not len(order):
            return
        seq, ts, stage, value = seq[order], ts[order], stage[order], value[order]
        names = np.array([STAGE_STATE.get(s, "processing") for s in stage], object)
        if was_finished:
            names[:] = name
        else:
            ends = np.flatnonzero(np.isin(names, FINISHED))
            if len(ends):
                names[ends[0] :] = names[ends[0]]
        value = np.maximum.accumulate(np.maximum(value, progress))
        created = ts[0] if created is None else np.datetime64(pd.Timestamp(created).tz_localize(None), "us")
        elapsed = (ts - created) / np.timedelta64(1, "ms")
        for at in range(0, len(seq), ANSWER):
            part = slice(at, at + ANSWER)
            yield pd.DataFrame({
                "job_id": key[0], "seq": seq[part], "state": names[part], "stage": stage[part], "progress": value[part],
                "elapsed_ms": np.floor(elapsed[part] + 0.5).astype("int64"), "updated_at": pd.Series(ts[part])})
        self.job.update((names[-1], float(value[-1]), int(seq[-1]), pd.Timestamp(created).to_pydatetime(), pd.Timestamp(ts[-1]).to_pydatetime()))
        if names[-1] in FINISHED and not was_finished:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retention_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: Any) -> Iterable[pd.DataFrame]:
        if self.job.exists():
            _, progress, seq, _, updated = self.job.get()
            self.job.clear()
            self.gone.update((seq,))
            yield pd.DataFrame([{"job_id": key[0], "seq": seq, "state": "expired", "stage": None, "progress": progress, "elapsed_ms": None, "updated_at": updated}])

    def close(self) -> None:
        pass


def job_state_stream(events: DataFrame, ttl_seconds: float = JOB_RETENTION_SECONDS) -> DataFrame:
    """State after every job event, in append mode; a finished job expires after the retention time.

    ``events``: job_id, seq, ts, stage, progress. A job's events are taken by (ts, seq); those at or
    before the last one folded are replays. ``operators.windows.job_states`` is the same rule over a whole table.
    """
    keep_state_on_disk(events.sparkSession)
    return events.groupBy("job_id").transformWithStateInPandas(
        JobStates(round(ttl_seconds * 1000)), JOB_OUT, "Append", "ProcessingTime")
