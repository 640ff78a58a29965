"""More relational queries: texts and search, tags and languages, shelves and lists, timelines, the queue, files."""

from __future__ import annotations

from collections.abc import Callable

from lectern.plans import pairs
from lectern.sources.views import DAY_MS, JOB_NOW_MS, NARRATION_CHARS_PER_SEC, NOW_MS, Dialect, Spark, round3

Text = Callable[[Dialect], str]

#: Three-letter language codes and the two-letter ones they stand for.
ISO3 = {
    "eng": "en", "heb": "he", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "rus": "ru", "ara": "ar", "nld": "nl", "dut": "nl",
    "jpn": "ja", "zho": "zh", "chi": "zh", "kor": "ko", "pol": "pl", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "tur": "tr", "ell": "el", "gre": "el", "ces": "cs",
    "cze": "cs", "ukr": "uk", "ron": "ro", "rum": "ro", "hun": "hu", "hin": "hi", "fas": "fa", "per": "fa",
}
#: Very common words of a language, a parameter of the guess.
MARKERS = {
    "en": ("the", "and", "of", "to", "in", "that", "was", "with"), "fr": ("le", "la", "les", "et", "des", "dans", "que", "une"),
    "de": ("der", "die", "und", "das", "ist", "nicht", "den", "mit"), "es": ("el", "los", "que", "una", "por", "con", "del", "las"),
}
NEEDLE = "the"
COURTESY = 60


def iso(code: str) -> str:
    return f"case {code} {' '.join(f'when {chr(39)}{a}{chr(39)} then {chr(39)}{b}{chr(39)}' for a, b in ISO3.items())}"


def tags(d: Dialect) -> str:
    """Raw tags as files carry them: lists with several separators, spaces, repeats and overlong items."""
    return f"""select p_partkey as id, ' ' || p_type || ' ; ' || p_brand || ',' || p_type || ' /' || p_name || case when p_partkey % 5 = 0 then ',' || repeat('x', 61) else '' end as raw,
        case p_partkey % 8 when 0 then 'ENG' when 1 then 'en-US' when 2 then ' fre ' when 3 then 'xx_YY' when 4 then 'und' when 5 then 'english' when 6 then 'tlh' end as tag from {d.table('part')}"""


def hits(d: Dialect) -> str:
    """(doc_id, at): every place of NEEDLE in a text, without case, not overlapping, from 0; the pieces between hits tell where they are."""
    pieces = d.numbered(f"(select doc_id, lower(text) as t from {d.table('documents')}) s", "doc_id", d.split("t", NEEDLE), "piece", "nth")
    return f"""select doc_id, nth, cast(upto + nth * {len(NEEDLE)} as bigint) as at_char from (select doc_id, nth, sum(length(piece)) over (partition by doc_id order by nth rows between unbounded preceding and current row) as upto,
        lead(nth) over (partition by doc_id order by nth) as following from ({pieces}) p) q where following is not null"""


def book_search(d: Dialect) -> str:
    flat = lambda x: d.sub(x, "[ \\t\\r\\n]+", " ")
    n = len(NEEDLE)
    return f"""select doc_id, at_char, {n} as match_length, case when lo > 0 then '…' else '' end || ltrim({flat('substring(text, cast(lo + 1 as int), cast(at_char - lo as int))')}) as before,
        {flat(f'substring(text, cast(at_char + 1 as int), {n})')} as found, rtrim({flat(f'substring(text, cast(at_char + {n} + 1 as int), cast(hi - at_char - {n} as int))')}) || case when hi < n_all then '…' else '' end as after
        from (select h.doc_id, h.at_char, t.text, cast(length(t.text) as bigint) as n_all, greatest(h.at_char - {COURTESY}, 0) as lo, least(h.at_char + {n} + {COURTESY}, cast(length(t.text) as bigint)) as hi
        from (select * from ({hits(d)}) a where nth < 100) h join {d.table('documents')} t on h.doc_id = t.doc_id) x"""


def offsets(d: Dialect) -> str:
    return f"select doc_id, cast(floor(k * n_chars / 7.0) as bigint) as at_char from (select doc_id, n_chars, {d.each('0', '6')} as k from {d.table('documents')}) o"


def in_sentences(d: Dialect) -> str:
    """Per place in a text the sentence that starts last at or before it and the next one: one window over both."""
    w = "over (partition by doc_id order by pos, probe rows between unbounded preceding and current row)"
    f = "over (partition by doc_id order by pos, probe rows between current row and unbounded following)"
    both = f"""select doc_id, start_at as pos, 0 as probe, cast(ord as bigint) as ord, end_at from v_sentences union all select doc_id, at_char, 1, cast(null as bigint), cast(null as bigint) from ({offsets(d)}) p"""
    return f"select * from (select doc_id, pos as at_char, probe, {d.last('ord')} {w} as ord, {d.last('end_at')} {w} as end_at, {d.first('ord')} {f} as following from ({both}) u) z where probe = 1"


def plain_text(d: Dialect, html: str) -> str:
    """Text of an HTML fragment by pattern: what scripts and styles hold goes, blocks end lines, no empty lines."""
    x = d.sub(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    x = d.sub(x, "(?i)</(p|div|h[1-6]|li|blockquote|section|article|tr|ul|ol)>|<br[^>]*>", "¶")
    x = d.sub(x, "<[^>]*>", "")
    x = d.sub(x, "[ \\t\\r\\n]+", " ")
    x = f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
    return d.sub(d.sub(x, "( ?¶ ?)+", "¶"), "^[¶ ]+|[¶ ]+$", "")


def queries(probes: Text, gaps: Callable[[], str], summary: Text, best: Text) -> dict[str, Text]:
    def split_tags(d: Dialect, seps: str) -> str:
        parts = d.numbered(f"({tags(d)}) r", "id", d.split("raw", f"[{seps}]"), "x", "nth")
        return f"select id, nth, trim(x) as tag from ({parts}) p where length(trim(x)) between 1 and 60"

    def markers(d: Dialect) -> str:
        words = d.numbered(f"(select doc_id, lower(text) as t from {d.table('documents')}) s", "doc_id", d.every("t", "[\\p{L}]+"), "word", "nth")
        score = ", ".join(f"cast(count(case when word in ({', '.join(chr(39) + w + chr(39) for w in ws)}) then 1 end) as double) / count(*) as {code}" for code, ws in MARKERS.items())
        rows = " union all ".join(f"select doc_id, n, '{code}' as language, {code} as score from scored" for code in MARKERS)
        return f"""with scored as (select doc_id, count(*) as n, {score} from ({words}) w group by doc_id), ranked as (select doc_id, n, language, score, row_number() over (partition by doc_id order by score desc, language) as rn,
            lead(score) over (partition by doc_id order by score desc, language) as runner_up from ({rows}) r)
            select doc_id, {round3('score')} as score, case when n >= 60 and score >= 0.02 and (runner_up = 0 or score / runner_up >= 1.4) then language end as language from ranked where rn = 1"""

    def uncertainty(d: Dialect) -> str:
        """Doubt of a place between two anchors: base, drift with the nearer side, and time that its characters don't account for."""
        w = "over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)"
        f = "over (partition by conv_id order by turn rows between 1 following and unbounded following)"
        rows = f"""select conv_id, turn, pos, anchor_ms, {d.last('anchor_pos')} {w} as b0, {d.last('anchor_ms')} {w} as m0, {d.first('anchor_pos')} {f} as b1, {d.first('anchor_ms')} {f} as m1 from
            (select conv_id, turn, start_ms / 60e0 as pos, case when turn % 3 = 0 then start_ms / 60e0 end as anchor_pos, case when turn % 3 = 0 then cast(start_ms + turn * 900 as double) end as anchor_ms from v_turns) a"""
        at = "(m0 + (pos - b0) / greatest(b1 - b0, 1e0) * (m1 - m0))"
        return f"""select conv_id, turn, floor(2000 + 0.15e0 * greatest(0e0, least({at} - m0, m1 - {at})) + greatest(0e0, m1 - m0 - (b1 - b0) * {1000 / NARRATION_CHARS_PER_SEC!r}e0) + 0.5) as uncertainty_ms
            from ({rows}) r where anchor_ms is null and b0 is not null and b1 is not null"""

    def suspects(d: Dialect) -> str:
        """Spans worth another look, widest first: as wide as two windows or a third of the grid, or read at an odd rate; and the blind head and tail."""
        span = "select conv_id, prev_start as from_ms, start_ms as to_ms, rate from v_rates"
        median = "(select conv_id, max(rate) as median from (select conv_id, rate, row_number() over (partition by conv_id order by rate) as rn, count(*) over (partition by conv_id) as n from v_rates where rate > 0) a where rn = cast(floor(n / 2.0) as bigint) + 1 group by conv_id)"
        odd = f"select s.conv_id, from_ms, to_ms, case when rate <= 0 or abs(ln(rate / median)) > ln(1.2e0) then 'suspect' else 'wide' end as reason from ({span}) s join {median} m on s.conv_id = m.conv_id"
        head = "select conv_id, cast(0 as bigint), min(start_ms), 'head' from v_segments group by conv_id union all select t.conv_id, max(s.end_ms), max(t.start_ms + t.n * 60), 'tail' from v_turns t join v_segments s on t.conv_id = s.conv_id group by t.conv_id"
        return f"""select conv_id, from_ms, to_ms, reason, row_number() over (partition by conv_id order by to_ms - from_ms desc, from_ms) as place from (select * from ({odd}) o where reason = 'suspect' or to_ms - from_ms >= 16000
            union all select * from ({head}) h) x where to_ms - from_ms >= greatest(2 * 800, 15000 / 3)"""

    def frames(d: Dialect) -> str:
        """Frames of scores, one row a frame and token; the vocabulary is blank, a special, and two letters."""
        return "select user_id, event_id as frame, case v when 0 then 'blank' when 1 then '<s>' when 2 then 'a' else 'b' end as token, v, (event_id * (v + 3) * 7919) % 101 as logit from (select user_id, event_id, " + d.each("0", "3") + " as v from v_events) f"

    def arrays(d: Dialect, x: str, by: str) -> str:
        return d.split(d.joined(f"cast({x} as string)", by), ",")

    found: dict[str, Text] = {
        # texts and search
        "flt_12_book_search": book_search,
        "flt_13_nearest_hit": lambda d: f"""select doc_id, min_by(at_char, abs(at_char - near) * 1000000 + at_char) as at_char from (select h.doc_id, h.at_char, cast(floor(t.n_chars / 2.0) as bigint) as near
            from ({hits(d)}) h join {d.table('documents')} t on h.doc_id = t.doc_id) x group by doc_id""",
        "str_10_extract_text": lambda d: f"select page_id, {plain_text(d, 'html')} as text from {d.table('pages')}",
        "str_11_sentences": lambda d: f"""select doc_id, cast(ord as bigint) as ord, start_at, end_at, 's' || substring({d.sha("cast(doc_id as string) || chr(10) || norm")}, 1, 16) as id from (select doc_id, ord, start_at, end_at,
            lower(trim({d.sub('sentence', '[ \\t\\r\\n]+', ' ')})) as norm from v_sentences) s where norm <> ''""",
        "join_18_sentence_at": lambda d: f"select doc_id, at_char, ord, at_char < end_at as inside from ({in_sentences(d)}) x",
        "join_21_cue_for_offset": lambda d: f"select doc_id, at_char, case when at_char < end_at then ord else following end as ord from ({in_sentences(d)}) x",
        "str_14_entities": lambda d: f"""select page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as decoded from {d.table('pages')}""",
        "str_19_detect_language": markers,
        "agg_18_marker_scores": markers,
        "src_08_index": lambda d: f"select conv_id, count(*) as chapters, cast(sum(length(text)) as bigint) as total_chars, max(turn) as last_chapter, {d.sha(d.joined('text', 'turn', '|'))} as digest from {d.table('conversations')} group by conv_id",
        # tags, languages, identifiers
        "str_02_audio_tags": lambda d: f"select id, tag, min(nth) as first_at from ({split_tags(d, ',;/')}) t group by id, tag",
        "str_02_package_tags": lambda d: f"select id, tag, min(nth) as first_at from ({split_tags(d, ',;')}) t group by id, tag",
        "str_03_normalise_language": lambda d: f"""select id, {iso('base')} else case when {d.hit('base', '^[a-z][a-z][a-z]?$')} then base end end as language from
            (select id, {d.found("lower(trim(tag))", "^([^-_]*)", 1)} as base from ({tags(d)}) t where tag is not null) b""",
        "str_04_language_code": lambda d: f"""select id, case when base in ('und', 'unknown') then null when {d.hit('base', '^[a-z][a-z]$')} then base else {iso('base')} end end as code from
            (select id, {d.found("lower(trim(tag))", "^([^-_]*)", 1)} as base from ({tags(d)}) t where tag is not null) b""",
        "str_21_inside": lambda d: f"""select page_id, path = root or path like root || '/%' as inside from (select page_id, {d.sub(d.sub('url', '^[a-z]+://[^/]*|[?#].*$', ''), '/+$', '')} as path, '/en' as root from {d.table('pages')}) x""",
        "set_01_genres": lambda d: "select book_id, " + d.joined_set("genre") + " as genres from v_tracks group by book_id",
        "set_06_identifiers": lambda d: f"""select e.id as ebook_id, a.id as audio_id from (select *, {d.array("cast(size as string)", "lower(author)")} as ids from v_books where kind = 'ebook') e join (select *, {d.array("cast(size % 7 as string)", "lower(series)")} as ids
            from v_books where kind = 'audio') a on e.title = a.title and e.author = a.author where {d.meets('e.ids', 'a.ids')}""",
        "map_01_values_overlap": lambda d: f"""select id, {d.meets(d.array("'isbn' || cast(size % 5 as string)", "'id' || cast(id % 4 as string)"), d.array("'isbn' || cast(id % 5 as string)", "'id' || cast(size % 4 as string)"))} as overlap from v_books""",
        "flt_22_visible_facets": lambda d: f"""select user_id, case when chosen then {d.line(d.kept('picks', "x in ('genre', 'publisher', 'year')"), ',')} when has_default then {d.line(d.kept(d.array("'genre'", "'series'"), "x in ('genre', 'publisher', 'year')"), ',')}
            else {d.line(d.part(d.array("'publisher'", "'year'", "'rating'"), 1, 2), ',')} end as shown from (select user_id, user_id % 3 = 0 as chosen, user_id % 3 = 1 as has_default, {d.split("case when user_id % 2 = 0 then 'year,series,publisher' else 'rating' end", ',')} as picks
            from (select distinct user_id from v_events) u) p""",
        "map_02_newest_prefs": lambda d: """select user_id, max_by(theme, at_ms * 1000000 + event_id) as theme, max_by(font, at_ms * 1000000 + event_id) as font from (select user_id, event_id, at_ms, case when session = 0 then 'dark' else 'light' end as theme, case when book_id % 2 = 0 then book_id else 0 end as font
            from v_events) p group by user_id""",
        "json_02_parse_or_default": lambda d: f"select event_id, coalesce({d.number(d.json('props', 'k'))}, -1) as k, coalesce({d.json('props', 'missing')}, 'none') as missing from {d.table('events')}",
        # filters and projections
        "flt_11_notes_filter": lambda d: f"""select id, colour from (select id, kind, lang, note, case when source in ('web', 'books') then source else 'yellow' end as colour from v_notes where deleted = 0) n where kind = 'note' and colour = 'yellow'
            and (position('on' in lower(note)) > 0 or position('on' in lang) > 0)""",
        "flt_21_device_shelf": lambda d: "select b.id from v_books b where b.id in (select book_id from v_shelf where shelf_id = 5) and b.kind = 'ebook' and position('r' in lower(b.title)) > 0 and b.scan_state <> 'missing'",
        "flt_24_readable": lambda d: "select id from v_books where scan_state in ('ready', 'error') or (scan_state = 'discovered' and size > 0)",
        "flt_25_batch_verdicts": lambda d: f"""select event_id, case when k is null then 'invalid' when k > 90 then 'out of range' when value < 0 then 'negative' end as reason from (select event_id, value, {d.number(d.json('props', 'k'))} as k from {d.table('events')}) e
            where event_id % 97 <> 0""",
        "prj_03_users": lambda d: f"""select c.c_custkey as id, lower(c.c_name) as username, case c.c_mktsegment when 'BUILDING' then 'admin' else 'reader' end as role, coalesce(s.n, 0) as sessions, coalesce(p.n, 0) as in_progress, i.n_name as invited_by from {d.table('customer')} c
            left join (select user_id, count(distinct session) as n from v_events group by user_id) s on c.c_custkey = s.user_id left join (select user_id, count(*) as n from v_state where not finished group by user_id) p on c.c_custkey = p.user_id
            left join {d.table('nation')} i on c.c_nationkey = i.n_nationkey""",
        "prj_08_details": lambda d: "select book_id, idx, coalesce(title, 'Track ' || cast(idx + 1 as string)) as title, start_ms, duration_ms, start_ms + duration_ms as end_ms from v_offsets",
        "prj_11_evidence": lambda d: f"""select pair_id, {d.line(d.concat(d.kept(d.array("'Audio: short'", "'Text ' || status", "'Audio: ' || cast(ebook_id % 3 as string)"), "x not like 'Audio:%'"), d.array("case when coverage < 0.7 then 'Audio: compatible? ' else 'Audio: fits' end")), '|')} as notes,
            coverage as content_score, coverage < 0.7 as warned from v_pairs""",
        "join_04_reading_list": lambda d: "select l.shelf_id as user_id, b.id, b.title, l.rank from v_shelf l join v_books b on l.book_id = b.id where l.price > 100000 and b.scan_state <> 'missing'",
        "join_06_shelves_of_book": lambda d: "select i.book_id, s.shelf_id from v_shelf i join (select distinct shelf_id, shelf_id % 10 as owner from v_shelf) s on i.shelf_id = s.shelf_id where s.owner = 3",
        "join_08_session_user": lambda d: f"""select s.session, c.c_custkey from (select distinct user_id, session, {d.sha("'token-' || cast(user_id as string)")} as token from v_events) s join (select c_custkey, {d.sha("'token-' || cast(c_custkey as string)")} as token from {d.table('customer')}) c on s.token = c.token""",
        "join_17_chapter_at": lambda d: f"""select book_id, t, idx, coalesce(following, total) as end_ms from (select o.book_id, q.t, o.idx, o.following, q.total, row_number() over (partition by o.book_id, q.t order by o.start_ms desc, o.idx desc) as rn from
            (select *, lead(start_ms) over (partition by book_id order by idx) as following from v_offsets) o join (select book_id, total, cast(floor(total * k / 5.0) as bigint) as t from (select book_id, total, {d.each('0', '4')} as k from
            (select book_id, cast(sum(duration_ms) as bigint) as total from v_offsets group by book_id) a) b) q on o.book_id = q.book_id and o.start_ms <= q.t + 250) x where rn = 1""",
        "join_23_import_outcome": lambda d: pairs.outcomes(d) if isinstance(d, Spark) else f"""select f.pair_key, case when p.pair_id is null then 'unmatched' when exists_already then 'already' else 'imported' end as outcome from (select distinct substring({d.sha("cast(ebook_id as string) || '|' || cast(audio_id + pair_id % 2 as string)")}, 1, 24) as pair_key from v_pairs) f
            left join (select pair_id, coverage >= 0.5 as exists_already, substring({d.sha("cast(ebook_id as string) || '|' || cast(audio_id as string)")}, 1, 24) as pair_key from v_pairs) p on f.pair_key = p.pair_key""",
        "join_25_toc": lambda d: f"""select t.conv_id, t.nth, s.turn as spine_idx from (select conv_id, turn as nth, case when turn % 5 = 4 then 'lost.html' else 'ch' || cast(turn as string) || '.html' end as href from v_turns) t
            join (select conv_id, turn, 'ch' || cast(turn as string) || '.html' as href from v_turns) s on t.conv_id = s.conv_id and t.href = s.href""",
        "join_27_offline_switch": lambda d: f"""select x.conv_id, x.t, max(s.start_ms) as at_ms, max_by(s.ord, s.start_ms) as ord from ({probes(d)}) x join (select *, cast(floor(start_ms / 60000.0) as bigint) as minute, lead(start_ms) over (partition by conv_id order by ord) as following from v_segments) s
            on x.conv_id = s.conv_id and s.start_ms <= x.t and (s.following is null or s.following > x.t) group by x.conv_id, x.t""",
        "join_30_track_span": lambda d: f"""select q.book_id, q.t, o.idx from (select book_id, cast(k as bigint) * 900000 as t from (select book_id, {d.each('0', 'cast(floor(total / 900000.0) as bigint)')} as k from (select book_id, cast(sum(duration_ms) as bigint) as total from v_offsets group by book_id) a) e) q
            join v_offsets o on q.book_id = o.book_id and o.start_ms <= q.t and q.t < o.start_ms + o.duration_ms""",
        "join_32_inverse_locator": lambda d: f"""select conv_id, pct, max(turn) as chapter, max_by(cast(floor(target - cum) as bigint), turn) as char_offset from (select c.conv_id, c.turn, c.cum, q.pct, q.pct * q.total as target from
            (select conv_id, turn, cast(start_ms / 60 as double) as cum from v_turns) c join (select conv_id, total, k / 4e0 as pct from (select conv_id, total, {d.each('0', '4')} as k from (select conv_id, cast(sum(n) as double) as total from v_turns group by conv_id) a) b) q
            on c.conv_id = q.conv_id) x where cum <= target group by conv_id, pct""",
        # aggregates
        "agg_16_per_user": lambda d: "select e.user_id, count(distinct e.session) as sessions, max(coalesce(s.n, 0)) as in_progress from v_events e left join (select user_id, count(*) as n from v_state where not finished and pct > 0.001 group by user_id) s on e.user_id = s.user_id group by e.user_id",
        "agg_23_audio_totals": lambda d: f"select book_id, max(start_ms + duration_ms) as total_ms, {round3('cast(sum(case when genre = ' + chr(39) + 'R' + chr(39) + ' then duration_ms else 0 end) as double) / greatest(sum(duration_ms), 1)')} as ratio, cast(ceil(max(start_ms + duration_ms) / 150000.0) as bigint) as probes from v_offsets group by book_id",
        "agg_24_colour": lambda d: f"""select author, {', '.join(round3(f'sum({c} * w) / sum(w)') + f' as {c}' for c in 'rgb')} from (select *, (cast(greatest(r, g, b) - least(r, g, b) as double) / greatest(greatest(r, g, b), 1)) * (1 - abs((r + g + b) / 3e0 - 128) / 128) + 0.01e0 as w from
            (select author, size * 5 as r, id % 256 as g, (id * 7 + size) % 256 as b, (id % 10) / 10e0 as alpha from v_books) c where alpha >= 0.5) x group by author""",
        "agg_27_folder_stats": lambda d: f"select book_id % 20 as folder, count(*) as files, cast(sum(duration_ms) as bigint) as bytes from v_tracks group by book_id % 20",
        "agg_30_batch_ack": lambda d: "select user_id, count(distinct book_id) as books, max_by(book_id, event_id) as last_book, max(event_id) as last_event from v_events where event_id % 3 = 1 group by user_id",
        "date_01_ages": lambda d: f"""select id, cast(floor(({NOW_MS} - added_ms) / {DAY_MS}e0) as bigint) as days, case when {NOW_MS} - added_ms < 60000 then 'just now' when {NOW_MS} - added_ms < 3600000 then cast(cast(floor(({NOW_MS} - added_ms) / 60000e0) as bigint) as string) || ' min ago'
            when {NOW_MS} - added_ms < {DAY_MS} then cast(cast(floor(({NOW_MS} - added_ms) / 3600000e0) as bigint) as string) || ' h ago' else cast(cast(floor(({NOW_MS} - added_ms) / {DAY_MS}e0) as bigint) as string) || ' d ago' end as ago from v_books""",
        "date_03_formats": lambda d: """select id, case when bytes < 1024 then cast(bytes as string) || ' B' when bytes < 1048576 then cast(cast(floor(bytes / 1024e0 + 0.5) as bigint) as string) || ' KB' else cast(cast(floor(bytes / 1048576e0 + 0.5) as bigint) as string) || ' MB' end as size_label,
            cast(cast(floor(share * 100 + 0.5) as bigint) as string) || '%' as pct_label, cast(id as string) || case when id % 100 between 11 and 13 then 'th' when id % 10 = 1 then 'st' when id % 10 = 2 then 'nd' when id % 10 = 3 then 'rd' else 'th' end as ordinal
            from (select id, size * size * size * 37 as bytes, (size % 101) / 100e0 as share from v_books) b""",
        "arr_01_columns_rows": lambda d: f"""select conv_id, nth, cast({d.part('starts', 1, 1000000)}[{'nth' if d.__class__.__name__ == 'Spark' else 'nth + 1'}] as bigint) as start_ms from (select * from ({d.numbered(f"(select conv_id, {arrays(d, 'start_ms', 'ord')} as starts from v_segments group by conv_id) c", "conv_id, starts", "starts", "x", "nth")}) n) r""",
        # windows and orders
        "win_10_ctc": lambda d: f"""select user_id, frame, token from (select user_id, frame, token, lag(token) over (partition by user_id order by frame) as prev from (select user_id, frame, token, row_number() over (partition by user_id, frame order by logit desc, v) as rn from ({frames(d)}) f) a where rn = 1) b
            where token <> 'blank' and (prev is null or token <> prev) and token not like '<%'""",
        "win_17_uncertainty": uncertainty,
        "win_18_refine_spans": suspects,
        "win_20_probe_breaks": lambda d: f"""select conv_id, t, is_break, case when is_break = 1 then '|' else 'p' end as mark from (select conv_id, t, 0 as is_break, lead(t) over (partition by conv_id order by t) as following from ({probes(d)}) a where t % 3 <> 0
            union all select conv_id, t, 1, following from (select conv_id, t, lead(t) over (partition by conv_id order by t) as following from ({probes(d)}) b where t % 3 <> 0) c where following is not null) x""",
        "win_21_lead_in": lambda d: "select conv_id, ord, least(cast(1200 as bigint), cast(floor(0.25e0 * uncertainty_ms + 0.5) as bigint)) as lead_ms from v_segments",
        "win_24_reorder": lambda d: """select shelf_id, book_id, row_number() over (partition by shelf_id order by case when place = 3 then 0.5e0 when place = 1 then 1e0 else cast(place as double) end) as place, lag(book_id) over (partition by shelf_id order by case when place = 3 then 0.5e0 else cast(place as double) end) as after_id
            from (select shelf_id, book_id, row_number() over (partition by shelf_id order by rank) as place from v_shelf) s""",
        "win_25_step_chapter": lambda d: """select book_id, idx, case when into_ms > 4000 then start_ms else coalesce(before_ms, start_ms) end as previous_ms, coalesce(after_ms, start_ms) as next_ms from (select book_id, idx, start_ms, (idx * 1700) % 9000 as into_ms,
            lag(start_ms) over (partition by book_id order by idx) as before_ms, lead(start_ms) over (partition by book_id order by idx) as after_ms from v_offsets) o""",
        "ord_01_title": lambda d: "select id, place from (select id, row_number() over (order by lower(title), id) as place from v_books where scan_state <> 'missing') o",
        "ord_04_ladders": lambda d: """select pair_id, row_number() over (partition by ebook_id order by case status when 'confirmed' then 0 when 'auto' then 1 when 'candidate' then 2 else 3 end, score desc, pair_id) as by_trust,
            row_number() over (partition by ebook_id order by case status when 'candidate' then 0 when 'auto' then 1 else 2 end, score desc, pair_id) as by_need from v_pairs""",
        "ord_07_binary": lambda d: f"select id, row_number() over (order by rank_key, id) as place from (select id, substring({d.sha('cast(id as string)')}, 1, 6) || case when id % 2 = 0 then upper(substring(title, 1, 2)) else substring(title, 1, 2) end as rank_key from v_books) k",
        "ord_08_natural": lambda d: f"""select id, row_number() over (order by nat, id) as place from (select id, {d.line(d.mapped(d.every("lower('Chapter ' || cast(id % 120 as string) || ' part ' || cast(size as string))", '[0-9]+|[^0-9]+'), "case when x >= '0' and x < ':' then lpad(x, 12, '0') else x end"), '')} as nat from v_books) n""",
        "ord_10_children": lambda d: "select conv_id, version, ord, row_number() over (partition by conv_id, version order by ord) as place from v_aligned",
        "ord_12_shelf_modes": lambda d: "select s.shelf_id, s.book_id, row_number() over (partition by s.shelf_id order by s.rank) as manual, row_number() over (partition by s.shelf_id order by lower(b.title), b.id) as by_title, row_number() over (partition by s.shelf_id order by b.author asc nulls last, b.id) as by_author, row_number() over (partition by s.shelf_id order by b.added_ms desc, b.id) as by_added from v_shelf s join v_books b on s.book_id = b.id where b.scan_state <> 'missing'",
        # files, queue and snapshots
        "src_02_grouping": lambda d: f"""select key, count(*) as tracks, cast(sum(bytes) as bigint) as bytes, {d.sha(d.joined('hash', 'nat, name'))} as hash from (select case when depth = 0 then 'file:' || name else 'dir:' || folder end as key, name, bytes, {d.sha("name || cast(bytes as string)")} as hash,
            {d.line(d.mapped(d.every('name', '[0-9]+|[^0-9]+'), "case when x >= '0' and x < ':' then lpad(x, 12, '0') else x end"), '')} as nat from (select book_id % 4 as depth, 'book ' || cast(book_id as string) as folder, 'track ' || cast(book_id as string) || '-' || cast(idx as string) || '.mp3' as name, duration_ms as bytes from v_tracks) f) g group by key""",
        "snk_05_collectable": lambda d: f"select id, lease_ms as retired_ms from v_jobs where state = 'done' and lease_ms + 5 * 60000 <= {JOB_NOW_MS}",
        "stm_09_deferred_gc": lambda d: f"select count(case when lease_ms + 5 * 60000 <= {JOB_NOW_MS} then 1 end) as collected, count(case when lease_ms + 5 * 60000 > {JOB_NOW_MS} then 1 end) as waiting from v_jobs where state = 'done'",
        "snk_06_replace_children": lambda d: "select book_id, kind, fold from v_facets where book_id % 9 <> 0 union all select distinct book_id, 'genre', lower(genre) from (select p.id as book_id, t.genre from v_books p join v_tracks t on p.id = t.book_id) n where book_id % 9 = 0",
        "snk_13_enqueue": lambda d: """select n.id, n.dedupe_key from (select id, type || ':' || cast(book_id as string) as dedupe_key, row_number() over (partition by type, book_id order by id) as rn from v_jobs where state = 'done') n
            where rn = 1 and not exists (select 1 from v_jobs j where j.state in ('queued', 'running') and j.type || ':' || cast(j.book_id as string) = n.dedupe_key)""",
        "snk_13_retry": lambda d: f"select id, case when state = 'done' and error is not null then 'queued' when state = 'running' and lease_ms < {JOB_NOW_MS} and attempts < 3 then 'queued' when state = 'running' and lease_ms < {JOB_NOW_MS} then 'failed' else state end as state, case when state = 'done' and error is not null then 0 else attempts end as attempts from v_jobs",
        "snk_14_manifest": lambda d: f"""select page_id, max(size) as size, max(whole) as whole, {d.joined('chunk', 'nth')} as chunks from (select page_id, nth, size, whole, {d.sha('substring(html, cast(nth * 4096 + 1 as int), 4096)')} as chunk from
            (select page_id, html, length(html) as size, {d.sha('html')} as whole, {d.each('0', 'cast(floor((greatest(length(html), 1) - 1) / 4096.0) as bigint)')} as nth from {d.table('pages')}) c) h group by page_id""",
    }
    return found
