"""Ordered folds: states that a row changes depending on all before it, as one aggregate over a sorted array."""

from __future__ import annotations

from collections.abc import Callable

from lectern.sources.views import FUTURE_SKEW_MS, NOW_MS, Dialect, round3

Text = Callable[[Dialect], str]

EXPLICIT = "('open', 'pause', 'seek', 'switch', 'finish')"
#: The log of progress events as it arrives: some come a second time, for another book.
LOG = "(select user_id, book_id, event_id, session, seq, intent, at_ms, pct from v_events union all select user_id, book_id + 1, event_id, session, seq, intent, at_ms, pct from v_events where event_id % 10 = 0)"
FIRST = f"(select * from (select *, row_number() over (partition by user_id, event_id order by book_id) as nth from {LOG} l) f where nth = 1)"


def _event(d: Dialect) -> str:
    when = f"least(coalesce(at_ms, {NOW_MS}), {NOW_MS + FUTURE_SKEW_MS})"
    return d.record(
        revision="cast(0 as bigint)", claim=f"cast({when} as bigint)", session="cast(session as bigint)", seq="cast(seq as bigint)", intent="intent", finished="false", pct="cast(pct as double)", refused="cast(0 as bigint)"
    )


def _start(d: Dialect) -> str:
    return d.record(
        revision="cast(0 as bigint)", claim="cast(0 as bigint)", session="cast(-1 as bigint)", seq="cast(-1 as bigint)", intent="''", finished="false", pct="cast(0 as double)", refused="cast(0 as bigint)"
    )


def _step(d: Dialect, after: str) -> str:
    """What an event x makes of state a; `after`: the revision after an event that applies."""
    explicit = f"x.intent in {EXPLICIT}"
    applies = f"(a.revision = 0 or ({explicit} and (x.claim > a.claim or (x.claim = a.claim and x.session = a.session and x.seq > a.seq))) or (not {explicit} and x.session = a.session and x.seq > a.seq))"
    beat = f"(not {explicit} and a.revision > 0)"
    pick = lambda new, old: f"case when {applies} then {new} else {old} end"
    return d.record(
        revision=pick(after, "a.revision"), claim=pick(f"case when {beat} then a.claim else x.claim end", "a.claim"), session=pick(f"case when {beat} then a.session else x.session end", "a.session"), seq=pick("x.seq", "a.seq"),
        intent=pick("x.intent", "a.intent"), finished=pick(f"(x.intent = 'finish' or ({beat} and a.finished))", "a.finished"), pct=pick("x.pct", "a.pct"), refused=f"a.refused + case when {applies} then 0 else 1 end",
    )


def states(d: Dialect, rows: str = FIRST) -> str:
    fold = d.fold(d.ordered(_event(d), "event_id", "book_id"), _start(d), _step(d, "a.revision + 1"))
    return f"select user_id, book_id, {fold} as s from {rows} r group by user_id, book_id"


def resume(d: Dialect) -> str:
    """Events that a device still holds, replayed in order of clamped time and place over the state of the server."""
    server = states(d, "(select * from v_events where session < 2)")
    when = f"least(coalesce(at_ms, {NOW_MS}), {NOW_MS + FUTURE_SKEW_MS})"
    held = f"select user_id, book_id, {d.ordered(_event(d), when, 'seq')} as held from v_events where session = 2 group by user_id, book_id"
    fold = d.fold("h.held", "v.s", _step(d, "greatest(a.revision, cast(1 as bigint))"))
    both = f"select h.user_id, h.book_id, v.s.pct as server_pct, v.s.claim as server_claim, v.s.seq as server_seq, {fold} as s from ({held}) h join ({server}) v on h.user_id = v.user_id and h.book_id = v.book_id"
    return f"select user_id, book_id, {round3('s.pct')} as pct, case when s.seq = server_seq and s.claim = server_claim then 'server' else 'local' end as source, s.claim as claim_ms from ({both}) b"


def throughput(d: Dialect) -> str:
    """A moving mean of rates, 0.7 old and 0.3 new, that starts again when a rate is three times off; rates out of bounds are left out."""
    step = d.record(v="case when a.v = 0 or x.v > 3 * a.v or 3 * x.v < a.v then x.v else 0.7e0 * a.v + 0.3e0 * x.v end")
    fold = d.fold(d.ordered(d.record(v="cast(rate as double)"), "ord"), d.record(v="cast(0 as double)"), step)
    return f"select conv_id, {round3('f.v')} as rate from (select conv_id, {fold} as f from (select conv_id, ord, rate / 100 as rate from v_rates) r where rate > 0 and rate <= 500 group by conv_id) g"


def attempts(d: Dialect) -> str:
    """Attempts in the window that is open: five minutes from its first one, then a new one."""
    step = d.record(since="case when x.since - a.since >= 300000 then x.since else a.since end", n="case when x.since - a.since >= 300000 then cast(1 as bigint) else a.n + 1 end")
    fold = d.fold(d.ordered(d.record(since="cast(at_ms as bigint)", n="cast(1 as bigint)"), "at_ms", "event_id"), d.record(since="cast(0 as bigint)", n="cast(0 as bigint)"), step)
    return f"select user_id, f.since as since_ms, f.n as n from (select user_id, {fold} as f from v_events group by user_id) g"


def outcomes() -> str:
    """The oracle of the reconciliation: event after event of a book, by recursion."""
    explicit = f"e.intent in {EXPLICIT}"
    applies = f"(f.revision = 0 or ({explicit} and (e.t > f.claim or (e.t = f.claim and e.session = f.sess and e.seq > f.seq))) or (not {explicit} and e.session = f.sess and e.seq > f.seq))"
    beat = f"(not {explicit} and f.revision > 0)"
    return f"""with recursive e as (select *, least(at_ms, {NOW_MS + FUTURE_SKEW_MS}) as t, row_number() over (partition by user_id, book_id order by event_id) as rn from {FIRST} q),
        f as (select distinct user_id, book_id, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(0 as bigint) as revision, cast(0 as bigint) as claim, cast(-1 as bigint) as sess, cast(-1 as bigint) as seq, '' as outcome from e
        union all select e.user_id, e.book_id, e.rn, e.event_id, case when {applies} then f.revision + 1 else f.revision end, case when {applies} and not {beat} then e.t else f.claim end, case when {applies} and not {beat} then e.session else f.sess end,
        case when {applies} then e.seq else f.seq end, case when {applies} then 'apply' when {explicit} then 'stale-explicit' when e.session <> f.sess then 'unclaimed-session' else 'stale-heartbeat' end
        from f join e on e.user_id = f.user_id and e.book_id = f.book_id and e.rn = f.rn + 1)
        select user_id, book_id, event_id, outcome from f where rn > 0 union all select user_id, book_id, event_id, 'duplicate' from (select *, row_number() over (partition by user_id, event_id order by book_id) as nth from {LOG} l) d where nth > 1"""


def monotone(d: Dialect) -> str:
    """Rows that start no more than 1,500 ms before the end of the last row kept."""
    rows = "(select conv_id, ord, case when ord % 3 = 2 then start_ms - 40000 else start_ms end as start_ms, end_ms from v_segments)"
    step = d.record(last="case when x.start >= a.last - 1500 then greatest(x.start, x.last) else a.last end", start="x.start", ord="x.ord", kept=f"case when x.start >= a.last - 1500 then {d.concat('a.kept', 'x.kept')} else a.kept end")
    item = d.record(last="cast(end_ms as bigint)", start="cast(start_ms as bigint)", ord="cast(ord as bigint)", kept=d.array("cast(ord as bigint)"))
    start = d.record(last="cast(-1 as bigint)", start="cast(0 as bigint)", ord="cast(-1 as bigint)", kept="cast(" + d.array() + (" as array<bigint>)" if type(d).__name__ == "Spark" else " as bigint[])"))
    fold = d.fold(d.ordered(item, "ord"), start, step)
    return f"select r.conv_id, r.ord, r.start_ms, r.end_ms from {rows} r join ({d.numbered(f'(select conv_id, {fold} as f from {rows} q group by conv_id) g', 'conv_id', 'f.kept', 'kept_ord', 'nth')}) k on r.conv_id = k.conv_id and r.ord = k.kept_ord"


QUERIES: dict[str, Text] = {
    "stm_02_state": lambda d: f"select user_id, book_id, s.revision as revision, s.claim as claim_ms, s.session as session, s.finished as finished, {round3('s.pct')} as pct, s.refused as refused from ({states(d)}) f",
    "stm_04_refused": lambda d: f"select user_id, cast(sum(s.refused) as bigint) as refused, count(*) as books from ({states(d)}) f group by user_id",
    "stm_05_resume": resume,
    "agg_13_throughput": throughput,
    "agg_29_attempts": attempts,
    "win_08_fold": monotone,
}
