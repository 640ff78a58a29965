"""The relational queries, each one text for a dialect; keys start with the identifier of the operator."""

from __future__ import annotations

from collections.abc import Callable

from lectern.plans import folds, listing, pairs
from lectern.sources.views import (
    AUTO_SCORE, CANDIDATE_SCORE, DAY_MS, DRIFT_MS, FUTURE_SKEW_MS, GAP_MIN_MS, NARRATION_CHARS_PER_SEC, NOW_MS, REWIND_CAP_MS, SWITCH_CONFIDENCE, SWITCH_COVERAGE, JOB_NOW_MS,
    Dialect, Spark, norm_title, round3, similarity,
)

Text = Callable[[Dialect], str]

RANK = "case status when 'confirmed' then 0 when 'auto' then 1 when 'candidate' then 2 else 3 end"


def best(d: Dialect) -> str:
    """Both sides of each pair, listed in one pass over the pairs, and the first of a book; Spark finds it without listing them."""
    if isinstance(d, Spark):
        return pairs.best(d)
    sides = f"select *, {d.each('0', '1')} as side from v_pairs where status <> 'rejected'"
    return f"""select book_id, pair_id, status, score, coverage, confidence from (select *, row_number() over (partition by book_id order by {RANK}, score desc, pair_id) as rn
        from (select case side when 0 then ebook_id else audio_id end as book_id, pair_id, status, score, coverage, confidence from ({sides}) b) x) y where rn = 1"""


def summary(d: Dialect, only: str = "") -> str:
    """The listing: every present book with its best pair, whether one can switch in it, and the state of one reader.

    `only` is a condition that a caller who reads pairs sets anyway; without it Spark drops the join with the pairs where no column of theirs is read.
    """
    books, p, where = f"v_books b left join ({best(d)}) bp on b.id = bp.book_id", "bp", " where b.scan_state <> 'missing'"
    few = "/*+ BROADCAST(s) */ " if isinstance(d, Spark) else ""  # the states of one reader are of 99 books at most
    if isinstance(d, Spark) and only:
        books, p, where = f"({pairs.shown(d, f"scan_state <> 'missing' and ({only})")}) b", "b", ""
    return f"""select {few}b.id, b.kind, b.title, b.author, b.series, b.language, b.added_ms, {p}.pair_id, {p}.status as pair_status, {p}.score as pair_score,
        coalesce({p}.coverage >= {SWITCH_COVERAGE} and {p}.confidence >= {SWITCH_CONFIDENCE}, false) as handoff, s.pct, s.finished, s.updated_ms
        from {books} left join (select * from v_state where user_id = 7) s on b.id % 50 = s.book_id{where}"""


#: Instants every 7 s in each conversation, to look up in its segments.
PROBES = "select conv_id, cast(k as bigint) * 7000 as t from (select conv_id, {each} as k from (select conv_id, max(start_ms + n * 60) as len from v_turns group by conv_id) x) e"


def probes(d: Dialect) -> str:
    return PROBES.format(each=d.each("0", "cast(floor(len / 7000.0) as bigint)"))


def around(d: Dialect) -> str:
    """Per probe the last segment that starts at or before it and the first that starts after it: one window over both, no join."""
    w = "over (partition by conv_id order by pos_ms, is_probe rows between unbounded preceding and current row)"
    f = "over (partition by conv_id order by pos_ms, is_probe rows between current row and unbounded following)"
    cols = ("ord", "start_ms", "end_ms", "confidence", "source", "uncertainty_ms")
    both = f"""select conv_id, start_ms as pos_ms, 0 as is_probe, {', '.join(cols)} from v_segments
        union all select conv_id, t, 1, {', '.join(f'cast(null as {k})' for k in ('bigint', 'bigint', 'bigint', 'double', 'string', 'bigint'))} from ({probes(d)}) p"""
    back = ", ".join(f"{d.last(c)} {w} as b_{c}" for c in cols)
    fore = ", ".join(f"{d.first(c)} {f} as a_{c}" for c in ("ord", "start_ms"))
    return f"select conv_id, pos_ms as t, {', '.join('b_' + c for c in cols)}, a_ord, a_start_ms from (select *, {back}, {fore} from ({both}) u) z where is_probe = 1"


def gaps() -> str:
    rows = "select conv_id, ord, start_ms, end_ms, lag(end_ms, 1, cast(0 as bigint)) over (partition by conv_id order by ord) as prev_end from v_segments"
    return f"select conv_id, prev_end as from_ms, start_ms as to_ms from ({rows}) g where start_ms - prev_end > {GAP_MIN_MS}"


def pair_score(d: Dialect, least: float | None = None) -> str:
    """The text of scores(), and how Spark reads it; `least` is a bound that the caller sets anyway."""
    return pairs.scan(d, scores(d, "in (select id from twice)"), least) if isinstance(d, Spark) else scores(d)


def scores(d: Dialect, several: str = "") -> str:
    """Scores of ebooks with audiobooks they may belong to: blocks are the author with a word of the title, and the whole title; pairs that exist are left out.

    Titles, authors and series are compared once for each distinct pair of values, not for each pair of books.
    """
    te, ta = "x", "y"
    tok = f"(cast({d.overlap(d.tokens(te), d.tokens(ta))} as double) / greatest({d.size(d.tokens(te))} + {d.size(d.tokens(ta))} - {d.overlap(d.tokens(te), d.tokens(ta))}, 1))"
    code = lambda x: f"case {x} when 'eng' then 'en' when 'fre' then 'fr' when 'und' then null else {x} end"
    books = f"""select id, kind, {norm_title(d, 'title')} as t, lower(author) as w, lower(series) as s, {code('language')} as lang, duration_ms, total_chars, size as ident from v_books where scan_state = 'ready'"""
    words = lambda k: f"select id, t, w, x as word from (select id, t, w, {d.parts('t', ' ')} as x from books where kind = '{k}') q group by id, t, w, x"
    lang = "case when e.lang is null or a.lang is null then 0.5 when e.lang = a.lang then 1.0 else 0.0 end"
    ratio = f"(a.duration_ms / (e.total_chars / {NARRATION_CHARS_PER_SEC}e0 * 1000))"
    same = "e.ident = a.ident and e.ident % 10 = 7"  # an identifier that both editions carry
    total = f"""0.5e0 * tt.sim + 0.25e0 * ww.sim + 0.08e0 * ({lang}) + 0.07e0 * (case when e.s is null or a.s is null then 0.5 when ss.sim > 0.85 then 1.0 else 0.0 end)
        + 0.1e0 * (case when {ratio} > 0.55 and {ratio} < 1.9 then 1.0 else 0.2 end)"""
    floored = f"case when {same} then greatest({total}, 0.96e0) else {total} end"
    capped = f"case when ({lang}) = 0.0 then least({floored}, 0.4e0) else {floored} end"
    block = f"""block as (select e.id as ebook_id, a.id as audio_id from ({words('ebook')}) e join ({words('audio')}) a on e.word = a.word and e.w = a.w
            union select e.id, a.id from (select id, t from books where kind = 'ebook') e join (select id, t from books where kind = 'audio') a on e.t = a.t)"""
    fresh = "fresh as (select b.ebook_id, b.audio_id from block b where not exists (select 1 from v_pairs p where p.ebook_id = b.ebook_id and p.audio_id = b.audio_id and p.status <> 'candidate'))"
    if several:  # only pairs with an id of these, on either side
        halves = [(f"where id {several}", ""), ("", f"where id {several}")]
        pick = lambda rows, where: f"(select * from ({rows}) q {where})"
        titled, shelved = (lambda k: f"select id, t from books where kind = '{k}'"), (lambda k: f"select id, title, series from v_books where kind = '{k}'")
        met = lambda rows, on: " union ".join(f"select e.id as ebook_id, a.id as audio_id from {pick(rows('ebook'), x)} e join {pick(rows('audio'), y)} a on {on}" for x, y in halves)
        block = f"block as ({met(words, 'e.word = a.word and e.w = a.w')} union {met(titled, 'e.t = a.t')})"
        known = met(shelved, "e.title = a.title and e.series = a.series and (e.id + a.id) % 8 <> 5")
        fresh = f"fresh as (select b.ebook_id, b.audio_id from block b left anti join ({known}) p on p.ebook_id = b.ebook_id and p.audio_id = b.audio_id)"
    titles = f"select x, y, greatest({similarity('x', 'y')}, {tok}) as sim from cand_titles"
    return f"""with books as ({books}),
        {block},
        {fresh},
        cand as (select e.id as ebook_id, a.id as audio_id, e.t as et, a.t as ta, e.w as ew, a.w as wa, e.s as es, a.s as sa from fresh f join books e on f.ebook_id = e.id join books a on f.audio_id = a.id),
        cand_titles as (select distinct et as x, ta as y from cand), titles as ({titles}),
        authors as (select x, y, {similarity('x', 'y')} as sim from (select distinct ew as x, wa as y from cand) q), series as (select x, y, {similarity('x', 'y')} as sim from (select distinct es as x, sa as y from cand) q)
        select e.id as ebook_id, a.id as audio_id, {round3(f'greatest(0e0, least(1e0, {capped}))')} as score from cand c join books e on c.ebook_id = e.id join books a on c.audio_id = a.id
        join titles tt on c.et = tt.x and c.ta = tt.y join authors ww on c.ew = ww.x and c.wa = ww.y left join series ss on c.es = ss.x and c.sa = ss.y"""


def search(term: str) -> str:
    return " or ".join(f"position('{term}' in lower(coalesce({c}, ''))) > 0" for c in ("title", "author", "series"))


#: A scan against the stored books: what happens to each.
MERGE = """select coalesce(o.id, n.id) as id, case when o.id is null then 'discovered' when n.id is null then case when o.scan_state = 'missing' then 'unchanged' else 'missing' end
        when o.size <> n.size or o.scan_state in ('error', 'missing') then 'changed' else 'unchanged' end as action from (select * from v_books where id % 7 <> 0) o
        full outer join (select id, size + case when id % 11 = 0 then 1 else 0 end as size from v_books where id % 5 <> 0) n on o.id = n.id"""

QUERIES: dict[str, Text] = {
    "flagship_library": lambda d: f"select * from {d.dealt('id', f'({summary(d, search("ring"))}) s where ({search("ring")})')} order by {d.asc('lower(title)')}, {d.asc('id')}",
    # filters and projections
    "flt_01_present": lambda d: "select id, title, scan_state from v_books where scan_state <> 'missing'",
    "flt_02_search": lambda d: f"select id, title, author, series from v_books where {search('rod')}",
    "flt_03_kind": lambda d: "select id, title from v_books where kind = 'audio'",
    "flt_04_paired": lambda d: f"select id, pair_id from ({summary(d, 'true')}) s where pair_id is not null and pair_status <> 'candidate'",
    "flt_05_in_progress": lambda d: f"select id, {round3('pct')} as pct from ({summary(d)}) s where pct is not null and not finished and pct > 0.001",
    "flt_06_finished": lambda d: f"select id from ({summary(d)}) s where finished",
    "flt_07_both_formats": lambda d: f"""select id, pair_id, kind from (select *, row_number() over (partition by pair_id order by case when kind = 'ebook' then 0 else 1 end, lower(title), id) as rn
        from {d.dealt('pair_id', f"({summary(d, 'true')}) s where pair_id is not null and pair_status <> 'candidate'")}) x where rn = 1""",
    "flt_08_facet": lambda d: f"""select b.id, b.title from v_books b where b.scan_state <> 'missing' and exists (select 1 from v_facets f where f.book_id = b.id and f.kind = 'genre' and f.fold = lower({d.sub("trim('  PROMO ')", "[ ]+", " ")}))
        union all select b.id, b.title from v_books b where b.scan_state <> 'missing' and lower({d.sub("trim(b.author)", "[ ]+", " ")}) = lower(trim(' BRAND#2 '))""",
    "flt_09_recently_added": lambda d: f"select id, added_ms from v_books where scan_state <> 'missing' and added_ms >= {NOW_MS - 30 * DAY_MS} order by added_ms desc, id limit 60",
    "flt_10_annotations": lambda d: """select n.id, n.kind, length(n.note) as note_chars, b.title from v_notes n left join v_books b on n.id = b.id where n.deleted = 0 and n.user_id = 3 and n.kind = coalesce(cast(null as string), n.kind)
        and (position('th' in lower(n.note)) > 0 or position('th' in lower(coalesce(b.title, ''))) > 0) order by n.id desc limit 500""",
    "flt_14_payload": lambda d: f"select event_id, user_id from {d.table('events')} where {d.json('props', 'k')} = '3'",
    "flt_15_owner": lambda d: "select event_id, pct from v_events where user_id = 11",
    "flt_16_role": lambda d: f"select c_custkey, c_mktsegment from {d.table('customer')} where case c_mktsegment when 'BUILDING' then 3 when 'MACHINERY' then 2 else 1 end >= 2",
    "flt_17_active_lease": lambda d: f"select id, state = 'running' and lease_ms > {JOB_NOW_MS} as leased, state in ('queued', 'running') as active from v_jobs",
    "flt_18_error_prefix": lambda d: f"select id, {d.found('error', '^model-missing:([^|]+)[|]', 1)} as model from v_jobs where error like 'model-missing:%'",
    "flt_19_lane": lambda d: "select id, case when type in ('align') then 'heavy' when type = 'download' then 'download' else 'light' end as lane from v_jobs",
    "flt_20_startable": lambda d: """select p.pair_id from v_pairs p where p.status = 'confirmed' and not exists (select 1 from v_segments s where s.conv_id = p.ebook_id % 600 and s.ord = 0)
        and not exists (select 1 from v_jobs j where j.type = 'align' and j.state in ('queued', 'running') and j.book_id = p.ebook_id)""",
    "flt_23_marks": lambda d: "select id, kind, row_number() over (order by start_at, id) as place from v_notes where kind in ('highlight', 'note') and medium = 'text' and spine = 3 and deleted = 0 and user_id = 4",
    "flt_26_divergence": lambda d: f"""select s.user_id, s.book_id, {round3('abs(s.pct - h.pct)')} as diff from v_state s join (select user_id, book_id, max_by(pct, event_id) as pct, max(event_id) as event_id from v_events where session = 0 group by user_id, book_id) h
        on s.user_id = h.user_id and s.book_id = h.book_id where abs(s.pct - h.pct) > 0.005 and s.last_event <> h.event_id""",
    "prj_01_summary": lambda d: f"select id, kind, pair_id, pair_status, pair_score, {round3('pct')} as pct, finished, handoff from ({summary(d, 'true')}) s",
    "prj_02_pair": lambda d: """select p.pair_id, e.title as ebook_title, a.title as audio_title, coalesce(nullif(e.language, 'und'), nullif(a.language, 'und'), 'en') as language,
        case when e.language <> 'und' then 'ebook' when a.language <> 'und' then 'audio' else 'default' end as language_from, l.version, l.n_segments from v_pairs p join v_books e on p.ebook_id = e.id join v_books a on p.audio_id = a.id
        left join (select conv_id, version, n_segments from (select conv_id, version, count(*) as n_segments, row_number() over (partition by conv_id order by version desc) as rn from v_aligned group by conv_id, version) z where rn = 1) l on p.ebook_id = l.conv_id""",
    "prj_04_job_subject": lambda d: "select j.id, j.type, case when j.type in ('align', 'index') then b.title else null end as subject from v_jobs j left join v_books b on j.book_id = b.id",
    "prj_05_switchable": lambda d: f"select pair_id, coverage >= {SWITCH_COVERAGE} and confidence >= {SWITCH_CONFIDENCE} as switchable from v_pairs where status <> 'rejected'",
    "prj_06_status_label": lambda d: "select pair_id, case when status = 'candidate' then 'Possible match' when coverage >= 0.5 then 'Aligned ' || cast(cast(floor(coverage * 100 + 0.5) as bigint) as string) || '%' else 'Partly aligned' end as label from v_pairs",
    "prj_07_facet_label": lambda d: """select distinct kind, value, case when kind = 'rating' then repeat('*', cast(floor(cast(value as bigint) / 2.0) as int)) || case when cast(value as bigint) % 2 = 1 then '+' else '' end
        when kind = 'language' then case value when 'en' then 'English' when 'eng' then 'English' when 'fre' then 'French' when 'he' then 'Hebrew' else upper(value) end else value end as label
        from (select kind, value from v_facets union all select 'language', language from v_books) f""",
    "prj_09_locator_pct": lambda d: f"select doc_id, {round3('least(1e0, greatest(0e0, cast(doc_id * 37 as double) / greatest(n_chars, 1)))')} as pct from {d.table('documents')}",
    "prj_10_language_ladder": lambda d: """select e.id, coalesce(case when e.size % 7 = 0 then 'he' end, nullif(e.language, 'und'), case when e.size % 3 = 0 then 'fr' end, 'en') as language,
        case when e.size % 7 = 0 then 'override' when e.language <> 'und' then 'book' when e.size % 3 = 0 then 'text' else 'default' end as step from v_books e""",
    # joins
    "join_01_facets_books": lambda d: "select f.kind, f.value, b.id from v_facets f join v_books b on f.book_id = b.id where b.scan_state <> 'missing'",
    "join_02_progress_books": lambda d: f"select s.user_id, b.id, b.title, {round3('s.pct')} as pct from v_state s join v_books b on s.book_id = b.id where b.scan_state <> 'missing'",
    "join_03_pairs_books": lambda d: "select p.pair_id, e.title as e_title, a.author as a_author from v_pairs p join v_books e on p.ebook_id = e.id join v_books a on p.audio_id = a.id",
    "join_05_shelf_books": lambda d: "select s.shelf_id, count(case when b.scan_state <> 'missing' then 1 end) as present, count(case when b.scan_state = 'missing' then 1 end) as missing from v_shelf s join v_books b on s.book_id = b.id group by s.shelf_id",
    "join_07_notes_labels": lambda d: f"select n.id, n.kind, l.quality from v_notes n join {d.table('labels')} l on n.id = l.doc_id",
    "join_09_left": lambda d: f"select c.c_custkey, n.n_name from {d.table('customer')} c left join {d.table('nation')} n on c.c_nationkey = n.n_nationkey and n.n_regionkey <> 2",
    "join_10_pending": lambda d: "select p.pair_id from v_pairs p where p.status in ('confirmed', 'auto') and not exists (select 1 from v_aligned g where g.conv_id = p.ebook_id) and not exists (select 1 from v_jobs j where j.type = 'align' and j.book_id = p.audio_id and j.state in ('queued', 'running'))",
    "join_11_pair_scan": lambda d: f"select * from ({pair_score(d, CANDIDATE_SCORE)}) s where score >= {CANDIDATE_SCORE}",
    "join_12_best_pair": best,
    "join_13_asof": lambda d: f"select conv_id, t, b_ord, a_ord from ({around(d)}) x",
    "join_13_resolve": lambda d: f"""select x.conv_id, x.t, case when b_ord is null and a_ord is null then 'none' when g.conv_id is not null then 'gap'
        when b_ord is null then case when a_start_ms - t <= {DRIFT_MS} then 'paragraph' else 'refused' end when t > b_end_ms + {DRIFT_MS} then 'refused' when b_confidence < {SWITCH_CONFIDENCE} then 'weak'
        when t <= b_end_ms and b_confidence >= 0.6 and b_source = 'exact' then 'sentence' else 'paragraph' end as outcome, coalesce(b_ord, a_ord) as ord
        from ({around(d)}) x left join ({gaps()}) g on x.conv_id = g.conv_id and g.from_ms < x.t and x.t < g.to_ms""",
    "join_14_text_to_audio": lambda d: f"""select conv_id, ord, case when b is null or ord - b > 8 then null when c < {SWITCH_CONFIDENCE} then null
        else greatest(cast(0 as bigint), s - least(greatest(u, cast(0 as bigint)), cast({REWIND_CAP_MS} as bigint))) end as ms from (select t.conv_id, t.turn as ord, {d.last('g.ord')} over w as b, {d.last('g.start_ms')} over w as s,
        {d.last('g.confidence')} over w as c, {d.last('g.uncertainty_ms')} over w as u from v_turns t left join v_segments g on t.conv_id = g.conv_id and t.turn = g.ord
        window w as (partition by t.conv_id order by t.turn rows between unbounded preceding and current row)) x""",
    "join_15_gap_containment": lambda d: f"select p.conv_id, p.t, g.from_ms, g.to_ms from ({probes(d)}) p join ({gaps()}) g on p.conv_id = g.conv_id and g.from_ms < p.t and p.t < g.to_ms",
    "join_16_track_at": lambda d: """select book_id, t, max(idx) as idx, max_by(least(t - start_ms, duration_ms), idx) as position_ms from (select o.book_id, o.idx, o.start_ms, o.duration_ms, q.t from v_offsets o
        join (select book_id, cast(floor(sum(duration_ms) * 0.6) as bigint) as t from v_offsets group by book_id) q on o.book_id = q.book_id and o.start_ms <= q.t) x group by book_id, t""",
    "join_19_cues": lambda d: "select t.conv_id, t.turn, s.start_ms, greatest(s.end_ms, s.start_ms + 1) as end_ms from v_turns t join v_segments s on t.conv_id = s.conv_id and t.turn = s.ord",
    "join_20_cue_state": lambda d: f"""select conv_id, t, case when b_ord is null then 'before' when t < b_end_ms then 'on' when a_ord is null and t > b_end_ms + 2500 then 'after' when t <= b_end_ms + 2500 then 'hold' else 'gap' end as state
        from ({around(d)}) x""",
    "join_24_unknown_sentences": lambda d: f"select distinct s.conv_id from v_segments s where not exists (select 1 from {d.table('conversations')} c where c.conv_id = s.conv_id and c.turn = s.ord and length(c.text) > 200)",
    "join_26_overlap": lambda d: f"""select a.conv_id, a.ord, b.from_ms from (select conv_id, ord, start_ms - 2000 as lo, end_ms + 2000 as hi from v_segments) a join ({gaps()}) b on a.conv_id = b.conv_id and a.lo < b.to_ms and b.from_ms < a.hi""",
    "join_28_counts_per_user": lambda d: f"""select c.c_custkey, coalesce(o.n, 0) as orders, coalesce(e.n, 0) as events from {d.table('customer')} c left join (select o_custkey, count(*) as n from {d.table('orders')} group by o_custkey) o
        on c.c_custkey = o.o_custkey left join (select user_id, count(*) as n from v_events group by user_id) e on c.c_custkey = e.user_id""",
    "join_31_near_bookmark": lambda d: f"""select conv_id, t, min(ord) as ord from (select p.conv_id, p.t, s.ord from (select conv_id, t, {d.each('cast(floor(t / 20000.0) as bigint) - 1', 'cast(floor(t / 20000.0) as bigint) + 1')} as bucket from ({probes(d)}) q) p
        join (select *, cast(floor(start_ms / 20000.0) as bigint) as slot from v_segments) s on p.conv_id = s.conv_id and p.bucket = s.slot where abs(s.start_ms - p.t) < 20000) x group by conv_id, t""",
    # aggregates
    "agg_01_overview": lambda d: f"""select * from (select count(case when kind = 'ebook' and scan_state <> 'missing' then 1 end) as ebooks, count(case when kind = 'audio' and scan_state <> 'missing' then 1 end) as audiobooks,
        count(case when scan_state = 'missing' then 1 end) as missing, count(case when scan_state = 'error' then 1 end) as failed, count(distinct author) as authors from v_books) b
        cross join (select count(case when status in ('confirmed', 'auto') then 1 end) as linked, count(case when status = 'candidate' then 1 end) as candidates from v_pairs) p
        cross join (select count(distinct conv_id) as alignments from v_aligned) a cross join (select count(case when state in ('queued', 'running') then 1 end) as jobs from v_jobs) j
        cross join (select count(*) as users from {d.table('customer')}) u""",
    "agg_02_column_facets": lambda d: "select lower(author) as fold, min(author) as value, count(*) as n from v_books where author is not null and trim(author) <> '' and scan_state <> 'missing' group by lower(author)",
    "agg_03_tag_facets": lambda d: "select f.kind, f.fold, min(f.value) as value, count(distinct f.book_id) as n from v_facets f join v_books b on f.book_id = b.id where b.scan_state <> 'missing' group by f.kind, f.fold",
    "agg_04_group_size": lambda d: "select kind, fold, n from (select kind, fold, count(*) as n, count(*) over (partition by kind) as options from v_facets group by kind, fold) x where options >= 2",
    "agg_05_confidence_per_minute": lambda d: f"select conv_id, cast(floor(start_ms / 60000.0) as bigint) as minute, {round3('avg(confidence)')} as confidence, count(*) as n from v_segments group by conv_id, cast(floor(start_ms / 60000.0) as bigint)",
    "agg_06_alignment_summary": lambda d: f"select conv_id, version, n, n_exact, {round3('cast(n_exact as double) / n_turns')} as exact_share from (select g.conv_id, g.version, count(*) as n, count(case when g.source = 'exact' then 1 end) as n_exact, max(t.n_turns) as n_turns from v_aligned g join (select conv_id, max(version) as top from v_aligned group by conv_id) m on g.conv_id = m.conv_id and g.version = m.top join (select conv_id, count(*) as n_turns from v_turns group by conv_id) t on g.conv_id = t.conv_id group by g.conv_id, g.version) x",
    "agg_07_max_version": lambda d: "select c.conv_id, coalesce(max(g.version), 0) + 1 as next_version from (select distinct conv_id from v_turns) c left join v_aligned g on c.conv_id = g.conv_id group by c.conv_id",
    "agg_08_pending_eta": lambda d: "select count(*) as n, cast(coalesce(sum(b.duration_ms), 0) as bigint) as total_ms, cast(floor(coalesce(sum(b.duration_ms), 0) / 0.4e0 + 0.5) as bigint) as eta_ms from v_pairs p join v_books b on p.audio_id = b.id where p.status in ('confirmed', 'auto') and not exists (select 1 from v_aligned g where g.conv_id = p.ebook_id) and not exists (select 1 from v_jobs j where j.type = 'align' and j.book_id = p.audio_id and j.state in ('queued', 'running'))",
    "agg_09_coverage": lambda d: f"select t.conv_id, {round3('cast(count(s.ord) as double) / count(*)')} as coverage, {round3('coalesce(avg(s.confidence), 0)')} as mean_confidence from v_turns t left join v_segments s on t.conv_id = s.conv_id and t.turn = s.ord group by t.conv_id",
    "agg_10_upper_median": lambda d: f"""select conv_id, {round3('max(rate)')} as median_rate from (select *, row_number() over (partition by conv_id order by rate) as rn, count(*) over (partition by conv_id) as n from
        (select conv_id, cast(n * 60 as double) / greatest(length_before, 1) as rate from (select conv_id, n, lag(n) over (partition by conv_id order by turn) as length_before from v_turns) a where length_before is not null) b) c
        where rn = cast(floor(n / 2.0) as bigint) + 1 group by conv_id""",
    "agg_11_mean_rate": lambda d: f"select conv_id, {round3('cast(max(start_ms) - min(start_ms) as double) / greatest(max(ord) - min(ord), 1)')} as rate from v_segments group by conv_id",
    "agg_14_auto_shelves": lambda d: f"""select * from (select user_id, count(case when not finished and pct > 0.001 then 1 end) as reading, count(case when finished then 1 end) as finished from v_state group by user_id) s
        cross join (select count(distinct pair_id) as both_formats from ({summary(d)}) m where pair_id is not null and pair_status <> 'candidate') b
        cross join (select least(count(*), 60) as recent from v_books where scan_state <> 'missing' and added_ms >= {NOW_MS - 30 * DAY_MS}) r""",
    "agg_15_shelf_next": lambda d: "select s.shelf_id, count(*) as n, min_by(case when b.scan_state <> 'missing' then s.book_id end, case when b.scan_state <> 'missing' then s.rank end) as next_book from v_shelf s join v_books b on s.book_id = b.id group by s.shelf_id",
    "agg_17_tracks_fold": lambda d: f"""select book_id, cast(sum(duration_ms) as bigint) as duration_ms, min_by(narrator, case when narrator is not null then idx end) as narrator, min_by(title, case when title is not null then idx end) as title,
        min_by(year, idx) as year, {d.joined_set('genre')} as genres, max(case when genre = 'R' then 1 else 0 end) = 1 as has_cover from v_tracks group by book_id""",
    "agg_19_script_share": lambda d: f"""select doc_id, letters, case when letters >= 120 and ru > 0.3 * letters then 'ru' when letters >= 120 and he > 0.3 * letters then 'he' when letters >= 120 and ar > 0.3 * letters then 'ar'
        when letters >= 120 and el > 0.3 * letters then 'el' end as language, {round3('cast(latin as double) / greatest(letters, 1)')} as latin from (select doc_id, {', '.join(f"length(text) - length({d.sub('text', p, '')}) as {n}" for n, p in (('letters', '[' + chr(92) + 'p{L}]'), ('latin', d.script('Latin')), ('ru', d.script('Cyrillic')), ('he', d.script('Hebrew')), ('ar', d.script('Arabic')), ('el', d.script('Greek'))))} from {d.table('documents')}) x""",
    "agg_20_fingerprint": lambda d: f"select conv_id, substring({d.sha('cast(count(*) as string) || chr(10) || ' + d.joined('cast(turn as string)', 'turn', '|'))}, 1, 32) as fingerprint from {d.table('conversations')} group by conv_id",
    "agg_21_timeline_fingerprint": lambda d: f"select book_id, substring({d.sha(d.joined('cast(cast(floor(duration_ms / 100.0 + 0.5) as bigint) as string)', 'idx'))}, 1, 32) as fingerprint from v_tracks group by book_id",
    "agg_22_pair_key": lambda d: f"select pair_id, substring({d.sha('cast(ebook_id as string) || chr(10) || cast(audio_id as string)')}, 1, 24) as pair_key from v_pairs",
    "agg_25_notes_by_kind": lambda d: f"""select user_id, spine, count(case when kind = 'highlight' then 1 end) as highlights, count(case when kind = 'note' then 1 end) as notes, count(case when kind = 'bookmark' then 1 end) as bookmarks, {d.joined('cast(id as string)', 'id')} as ids
        from v_notes where deleted = 0 group by user_id, spine""",
    "agg_26_library_stats": lambda d: f"select kind, count(*) as n, count(pair_id) as paired from ({summary(d)}) s group by kind",
    "agg_28_outcomes": lambda d: f"select action, count(*) as n from ({MERGE}) m group by action",
    "agg_31_latest_failure": lambda d: "select type, id from (select type, id, row_number() over (partition by type order by created_ms desc, id desc) as rn from v_jobs j where attempts = 4 and not exists (select 1 from v_jobs k where k.type = j.type and k.book_id = j.book_id and k.state = 'running')) x where rn = 1",
    "agg_32_scan_active": lambda d: "select count(case when state in ('queued', 'running') and type in ('scan', 'index') then 1 end) > 0 as scan_active, count(case when state in ('queued', 'running') and type = 'index' then 1 end) as pending_index from v_jobs",
    # windows
    "win_01_offsets": lambda d: "select book_id, idx, start_ms from v_offsets",
    "win_02_running_max": lambda d: "select event_id, user_id, max(at_ms) over (partition by user_id order by event_id rows between unbounded preceding and current row) as high_ms from v_events",
    "win_03_lag_rate": lambda d: f"select conv_id, ord, {round3('cast(start_ms - prev_start as double) / (ord - prev_ord)')} as rate from (select *, lag(start_ms) over (partition by conv_id order by ord) as prev_start, lag(ord) over (partition by conv_id order by ord) as prev_ord from v_segments) x where prev_ord is not null",
    "win_04_top_one": lambda d: "select user_id, book_id, event_id from (select *, row_number() over (partition by user_id, book_id order by case intent when 'finish' then 0 when 'seek' then 1 else 2 end, event_id desc) as rn from v_events) x where rn = 1",
    "win_06_gaps": lambda d: gaps(),
    "win_07_interpolate": lambda d: f"""select conv_id, turn, cast(floor(p_end + (greatest(n_start - p_end, cast(0 as bigint))) * (cast(upto - n as double) / total) + 0.5) as bigint) as start_ms from (select *,
        sum(n) over (partition by conv_id, island order by turn rows between unbounded preceding and current row) as upto, sum(n) over (partition by conv_id, island) as total, count(*) over (partition by conv_id, island) as run
        from (select t.conv_id, t.turn, greatest(t.n, 1) as n, s.ord, count(case when s.ord is not null then 1 end) over (partition by t.conv_id order by t.turn rows between unbounded preceding and current row) as island,
        {d.last('s.end_ms')} over (partition by t.conv_id order by t.turn rows between unbounded preceding and current row) as p_end,
        {d.first('s.start_ms')} over (partition by t.conv_id order by t.turn rows between current row and unbounded following) as n_start
        from v_turns t left join v_segments s on t.conv_id = s.conv_id and t.turn = s.ord) a where ord is null) b where run <= 3 and p_end is not null and n_start is not null""",
    "win_09_rle": lambda d: f"select conv_id, t, b_ord from (select conv_id, t, b_ord, lag(b_ord) over (partition by conv_id order by t) as prev, row_number() over (partition by conv_id order by t) as rn from ({around(d)}) x) y where rn = 1 or coalesce(prev, -1) <> coalesce(b_ord, -1)",
    "win_11_queue_place": lambda d: "select s.shelf_id, s.book_id, row_number() over (partition by s.shelf_id order by s.rank) as place from v_shelf s join v_books b on s.book_id = b.id where b.scan_state <> 'missing'",
    "win_12_neighbours": lambda d: "select shelf_id, book_id, lag(rank) over (partition by shelf_id order by rank) as before_rank, lead(rank) over (partition by shelf_id order by rank) as after_rank from v_shelf where book_id % 10 <> 3",
    "win_13_facet_cap": lambda d: "select kind, fold from (select kind, fold, row_number() over (partition by kind order by first_book, fold) as rn from (select kind, fold, min(book_id) as first_book from v_facets group by kind, fold) x) y where rn <= 24",
    "win_14_chapter_end": lambda d: "select book_id, idx, coalesce(lead(start_ms) over (partition by book_id order by idx), start_ms + duration_ms) as end_ms from v_offsets",
    "win_15_interpolation": lambda d: f"""select conv_id, t, case when b_ord is null then cast(a_ord as double) when a_ord is null then cast(b_ord as double)
        else {round3('b_ord + cast(t - b_start_ms as double) / greatest(a_start_ms - b_start_ms, 1) * (a_ord - b_ord)')} end as pos from ({around(d)}) x""",
    "win_16_nearest": lambda d: f"select conv_id, t, least(coalesce(t - b_start_ms, 1000000000000), coalesce(a_start_ms - t, 1000000000000)) as distance_ms from ({around(d)}) x",
    "win_19_probe_grid": lambda d: f"select conv_id, at_ms, least(at_ms + 8000, len) as end_ms from (select conv_id, len, cast(k as bigint) * 15000 as at_ms from (select conv_id, len, {d.each('0', 'cast(floor((len - 1) / 15000.0) as bigint)')} as k from (select conv_id, max(start_ms + n * 60) as len from v_turns group by conv_id) x) e) y",
    "win_22_safe_rewind": lambda d: f"select conv_id, ord, greatest(cast(0 as bigint), start_ms - least(uncertainty_ms, cast({REWIND_CAP_MS} as bigint))) as ms from v_segments",
    "win_23_batch": lambda d: "select user_id, event_id from (select *, row_number() over (partition by user_id order by at_ms, seq) as rn, sum(200 + event_id % 500) over (partition by user_id order by at_ms, seq rows between unbounded preceding and current row) as bytes from v_events) x where rn <= 200 and (rn = 1 or bytes <= 48 * 1024)",
    # orders and limits
    "ord_02_author": lambda d: f"""select mode, id, place from (select 'author' as mode, id, row_number() over (order by author asc nulls last, {d.asc('lower(title)')}, {d.asc('id')}) as place from v_books where scan_state <> 'missing'
        union all select 'added', id, row_number() over (order by added_ms desc, {d.asc('id')}) from v_books where scan_state <> 'missing'
        union all select 'recent', id, row_number() over (order by coalesce(updated_ms, added_ms) desc, {d.asc('id')}) from ({summary(d)}) m) o where place <= 100""",
    "ord_03_continue": lambda d: "select user_id, book_id, updated_ms from v_state where not finished order by updated_ms desc, user_id, book_id limit 8",
    "ord_05_claim": lambda d: "select lane, id from (select lane, id, row_number() over (partition by lane order by priority desc, created_ms, id) as rn from (select *, case when type = 'align' then 'heavy' when type = 'download' then 'download' else 'light' end as lane from v_jobs) j where state = 'queued') x where rn = 1",
    "ord_06_latest": lambda d: """select * from (select 'job' as what, id, row_number() over (order by created_ms desc, id desc) as place from v_jobs union all select 'failure', id, row_number() over (order by created_ms desc, id desc) from v_jobs where error is not null
        union all select 'done', id, row_number() over (order by created_ms desc, id desc) from v_jobs where state = 'done') x where place <= case what when 'job' then 100 when 'failure' then 20 else 8 end""",
    "ord_09_facets": lambda d: "select kind, value, row_number() over (partition by kind order by case when kind in ('year', 'rating') then -cast(value as bigint) else 0 end, value) as place from (select distinct kind, value from v_facets) x where kind in ('year', 'rating')",
    "ord_11_newest_100": lambda d: "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id order by at_ms desc, event_id desc) as rn from v_events) x where rn <= 100",
    # sets
    "set_02_distinct": lambda d: "select distinct kind, fold from v_facets",
    "set_03_no_longer_seen": lambda d: "select id from v_books except select id from v_books where size % 3 <> 0",
    "set_04_semi": lambda d: "select pair_id from v_pairs where ebook_id in (select id from v_books where scan_state = 'ready')",
    "set_05_first_mention": lambda d: "select user_id, book_id from (select user_id, book_id, row_number() over (partition by user_id, book_id order by event_id) as rn from v_events) x where rn = 1",
    "set_07_union": lambda d: "select id, 'a' as origin from v_books where kind = 'audio' union all select id, 'b' from v_books where size > 40",
    # scalars
    "str_01_fold": lambda d: f"select p_partkey, lower({d.sub('trim(p_type)', '[ ]+', ' ')}) as fold from {d.table('part')}",
    "str_05_titles": lambda d: f"select id, {norm_title(d, 'title')} as norm from v_books",
    "str_06_similarity": lambda d: f"select e.id, {round3(similarity('lower(e.title)', 'lower(coalesce(e.series, \'\'))'))} as sim from v_books e",
    "str_07_year": lambda d: f"""select id, year from (select id, cast(nullif({d.found('v', '[0-9][0-9][0-9][0-9]')}, '') as bigint) as year from (select o_orderkey as id, case o_orderkey % 4 when 0 then 'n.d.' when 1 then '(c) ' || substring(cast(o_orderdate as string), 1, 10)
        when 2 then cast(9000 + o_orderkey % 900 as string) || ' copies, ' || cast(o_orderdate as string) else 'no. 12, ' || substring(cast(o_orderdate as string), 1, 4) end as v from {d.table('orders')}) t) y where year between 1000 and 2026""",
    "str_08_identifiers": lambda d: f"""select id, case when {d.hit('v', '^[a-z]+:')} then {d.found('v', '^([a-z]+):', 1)} when {d.hit(d.sub('v', '[- ]', ''), '^(97[89])?[0-9]{9}[0-9Xx]$')} then 'isbn' else 'id' end as scheme from
        (select p_partkey as id, case p_partkey % 4 when 0 then '978-0-' || cast(1000000 + p_partkey as string) || '-1-2' when 1 then 'doi:10.1/' || p_name when 2 then cast(123456789 as string) || 'X' else p_name end as v from {d.table('part')}) i""",
    "str_15_parse_facet": lambda d: "select distinct substring(x, 1, position(':' in x) - 1) as kind, substring(x, position(':' in x) + 1) as value from (select kind || ':' || value as x from v_facets) y",
    "date_02_clamp": lambda d: f"select event_id, least(coalesce(at_ms, {NOW_MS}), cast({NOW_MS - 20 * DAY_MS + FUTURE_SKEW_MS} as bigint)) as eff_ms from v_events",
    "date_03_duration": lambda d: "select id, cast(cast(floor(duration_ms / 3600000.0) as bigint) as string) || 'h ' || lpad(cast(cast(floor(duration_ms / 60000.0) as bigint) % 60 as string), 2, '0') || 'm' as label from v_books",
    "math_01_round3": lambda d: f"select s_suppkey, {round3('s_acctbal / 7')} as x from {d.table('supplier')}",
    "math_02_half_star": lambda d: "select id, raw, case when raw >= 0 and raw <= 10 then floor(raw + 0.5) / 2 end as rating, case when size % 7 <= 5 then floor(2 * ((size % 7) + 0.3e0) + 0.5) / 2 end as stars from (select id, size, cast(size % 13 as double) + 0.4e0 - 1 as raw from v_books) b",
    "math_03_pair_score": pair_score,
    "math_04_log_ratio": lambda d: f"""select r.conv_id, r.ord, {round3('rate')} as rate, rate <= 0 or abs(ln(rate / m.median)) > ln(1.2e0) as suspect, floor(least(1e0, greatest(0e0, rate / (rate + m.median))) * 10000 + 0.5) / 10000 as pct4 from v_rates r join
        (select conv_id, max(rate) as median from (select conv_id, rate, row_number() over (partition by conv_id order by rate) as rn, count(*) over (partition by conv_id) as n from v_rates where rate > 0) a where rn = cast(floor(n / 2.0) as bigint) + 1 group by conv_id) m on r.conv_id = m.conv_id""",
    "math_05_frames": lambda d: f"select doc_id, cast(floor((n_chars * 16 - 400) / 320.0) as bigint) + 1 as frames from {d.table('documents')}",
    "json_01_extract": lambda d: f"select event_id, cast({d.json('props', 'k')} as bigint) as k from {d.table('events')}",
    # sinks as snapshots
    "snk_01_merge": lambda d: MERGE,
    "snk_02_upsert": lambda d: "select book_id, user_id, pct3 from (select user_id, book_id, floor(pct * 1000 + 0.5) / 1000 as pct3, row_number() over (partition by user_id, book_id order by event_id desc) as rn from v_events) x where rn = 1",
    "snk_03_insert_or_ignore": lambda d: "select kind, fold, book_id from (select kind, fold, book_id, row_number() over (partition by kind, fold order by book_id) as rn from v_facets) x where rn = 1",
    "snk_04_append_version": lambda d: "select s.conv_id, s.ord, coalesce(m.top, 0) + 1 as version from v_segments s left join (select conv_id, max(version) as top from v_aligned group by conv_id) m on s.conv_id = m.conv_id",
    "snk_08_export_missing": lambda d: "select distinct p.pair_id from v_pairs p where not exists (select 1 from v_pairs q where q.pair_id = p.pair_id and q.score >= 0.7)",
    "snk_09_soft_delete": lambda d: "select id, kind from v_notes where deleted = 0",
    "snk_10_cascade": lambda d: f"""select l.l_orderkey as order_key, count(*) as n from {d.table('lineitem')} l where exists (select 1 from {d.table('orders')} o join {d.table('customer')} c on o.o_custkey = c.c_custkey where o.o_orderkey = l.l_orderkey and c.c_acctbal >= 0)
        group by l.l_orderkey""",
    "snk_11_retention": lambda d: f"select event_id from v_events where not (intent = 'heartbeat' and at_ms < {NOW_MS - 20 * DAY_MS})",
    "snk_13_recover": lambda d: f"select id, case when state = 'running' and lease_ms < {JOB_NOW_MS} and attempts >= 3 then 'failed' when state = 'running' and lease_ms < {JOB_NOW_MS} then 'queued' else state end as state from v_jobs",
    "src_14_range": lambda d: f"""select page_id, case when status = 206 then lo end as first_byte, case when status = 206 then hi end as last_byte, status, case when status = 206 then substring(html, cast(lo + 1 as int), cast(hi - lo + 1 as int)) end as slice from
        (select *, case when lo is null or lo > hi or lo >= size then 416 else 206 end as status from (select page_id, html, size, case when a <> '' then cast(a as bigint) when z <> '' and cast(z as bigint) > 0 then greatest(size - cast(z as bigint), cast(0 as bigint)) end as lo,
        case when a <> '' and z <> '' then least(cast(z as bigint), size - 1) else size - 1 end as hi from (select page_id, html, size, {d.found('asked', '^bytes=([0-9]*)-([0-9]*)$', 1)} as a, {d.found('asked', '^bytes=([0-9]*)-([0-9]*)$', 2)} as z from
        (select page_id, html, cast(length(html) as bigint) as size, case page_id % 4 when 0 then 'bytes=10-' || cast(10 + page_id as string) when 1 then 'bytes=-' || cast(page_id as string) when 2 then 'bytes=' || cast(page_id * 40 as string) || '-' else 'bytes=9999999-' end as asked
        from {d.table('pages')}) h) g) f) e""",
    "src_15_chunks": lambda d: f"select id, cast(k as bigint) as chunk from (select id, {d.each('0', 'cast(floor((total_chars - 1) / 100000.0) as bigint)')} as k from v_books) e",
    # streams in batch form
    "stm_03_dedupe": lambda d: "select user_id, event_id from (select user_id, event_id, row_number() over (partition by user_id, event_id order by at_ms) as rn from (select * from v_events union all select * from v_events where event_id % 10 = 0) e) x where rn = 1",
    "stm_06_retention": lambda d: f"select count(*) as n, count(distinct user_id) as users from v_events where intent <> 'heartbeat' or at_ms >= {NOW_MS - 20 * DAY_MS}",
    "stm_07_history": lambda d: "select user_id, book_id, event_id from (select *, row_number() over (partition by user_id, book_id order by event_id desc) as rn from v_events) x where rn <= 100",
    "stm_08_lease": lambda d: f"""select id, case when rn = 1 and state = 'queued' then 'running' else state end as state, case when rn = 1 and state = 'queued' then attempts + 1 else attempts end as attempts,
        case when rn = 1 and state = 'queued' then {JOB_NOW_MS} + 120000 when state = 'running' then lease_ms end as lease_ms from (select *, row_number() over (partition by state, lane order by priority desc, created_ms, id) as rn from
        (select id, priority, created_ms, attempts, lease_ms, case when type = 'align' then 'heavy' when type = 'download' then 'download' else 'light' end as lane,
        case when state = 'running' and lease_ms < {JOB_NOW_MS} and attempts >= 3 then 'failed' when state = 'running' and lease_ms < {JOB_NOW_MS} then 'queued' else state end as state from v_jobs) r) c""",
    "stm_10_overlap_frames": lambda d: f"select conv_id, start_at, greatest(start_at - 1000, cast(0 as bigint)) as lo, least(start_at + 31000, len) as hi from (select conv_id, len, cast(k as bigint) * 30000 as start_at from (select conv_id, len, {d.each('0', 'cast(floor((len - 1) / 30000.0) as bigint)')} as k from (select conv_id, max(start_ms + n * 60) as len from v_turns group by conv_id) x) e) y",
}


def auto_pairs(d: Dialect) -> str:
    return f"select count(*) as n from ({pair_score(d, AUTO_SCORE)}) s where score >= {AUTO_SCORE}"


QUERIES["agg_auto_pairs"] = auto_pairs
QUERIES |= folds.QUERIES | listing.queries(probes, gaps, summary, best)
