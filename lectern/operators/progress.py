"""Reconciliation of reading progress: which event moves the state of a reader's book.

An explicit event wins if it saw the current revision, or by its clamped time, or at the same instant by its
place in the same session; a heartbeat only moves the state of the session that holds the claim. An event id
counts once for a reader, whatever the book.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

EXPLICIT = frozenset(("open", "pause", "seek", "switch", "finish"))
FUTURE_SKEW_MS = 120_000
KEEP_MS = 30 * 86_400_000


@dataclass
class State:
    revision: int = 0
    claim_ms: int = 0
    session: int | None = None
    seq: int = -1
    intent: str = ""
    finished: bool = False
    pct: float = 0.0


def verdict(state: State, intent: str, at_ms: int | None, session: int, seq: int, base: int | None, now_ms: int) -> str:
    """'apply', or why the event is recorded only."""
    if not state.revision:
        return "apply"
    when = min(now_ms if at_ms is None else at_ms, now_ms + FUTURE_SKEW_MS)
    claim = min(state.claim_ms, now_ms + FUTURE_SKEW_MS)
    if intent in EXPLICIT:
        seen = base is not None and base == state.revision
        later = when > claim or (when == claim and session == state.session and seq > state.seq)
        return "apply" if seen or later else "stale-explicit"
    if session != state.session:
        return "unclaimed-session"
    return "apply" if seq > state.seq else "stale-heartbeat"


def advance(state: State, intent: str, at_ms: int | None, session: int, seq: int, pct: float, now_ms: int) -> State:
    """The state after an event that applies; heartbeats inherit the claim, and only they keep `finished`."""
    beat = intent not in EXPLICIT and state.revision > 0
    when = min(now_ms if at_ms is None else at_ms, now_ms + FUTURE_SKEW_MS)
    return State(
        state.revision + 1, state.claim_ms if beat else when, state.session if beat else session, seq, intent,
        intent == "finish" or (beat and state.finished), pct,
    )


OUT = "user_id long, book_id long, event_id long, outcome string, revision long, claim_ms long, session long, finished boolean, pct double"
NAMES = [c.split(" ")[0] for c in OUT.split(", ")]


class Reader:
    """What is known of one reader: the state of each book, and the ids of events, each with its time."""

    def __init__(self, books: dict[int, State] | None = None, seen: dict[int, int] | None = None):
        self.books, self.seen = books or {}, seen or {}

    def take(self, rows: Iterable[tuple], now_ms: int) -> Iterator[tuple]:
        """Rows (user, book, event, session, seq, intent, at, base, pct) in order of arrival -> rows of OUT."""
        for user, book, event, session, seq, intent, at, base, pct in rows:
            at, base = (None if x is None or x != x else int(x) for x in (at, base))
            state = self.books.get(book, State())
            if event in self.seen:
                outcome = "duplicate"
            else:
                self.seen[event] = now_ms if at is None else at
                outcome = verdict(state, intent, at, session, seq, base, now_ms)
                if outcome == "apply":
                    state = self.books[book] = advance(state, intent, at, session, seq, pct, now_ms)
            yield user, book, event, outcome, state.revision, state.claim_ms, state.session, state.finished, state.pct

    def forget(self, now_ms: int) -> None:
        """Event ids older than the retention of the log."""
        self.seen = {e: t for e, t in self.seen.items() if t >= now_ms - KEEP_MS}


IN = ["user_id", "book_id", "event_id", "session", "seq", "intent", "at_ms", "base_revision", "pct"]


def fold_rows(g: pd.DataFrame, now_ms: int, reader: Reader | None = None) -> pd.DataFrame:
    """The events of one reader in order of arrival (event_id, then book): the outcome of each, and the state after it."""
    g = g.sort_values(["event_id", "book_id"], kind="stable")
    return pd.DataFrame(list((reader or Reader()).take(zip(*(g[c].tolist() for c in IN), strict=True), now_ms)), columns=NAMES)


def reconcile(events: DataFrame, now_ms: int) -> DataFrame:
    """events (columns IN) -> the outcome of each. One group is one reader's log."""
    return events.select(*IN).groupBy("user_id").applyInPandas(lambda g: fold_rows(g, now_ms), OUT)
