"""Reference-shaped views over the driver tables, as SQL text that both engines read.

A Dialect spells the few things Spark SQL and the oracle's SQL write differently. Views use whole
milliseconds for instants, so nothing depends on a session's time zone.
"""

from __future__ import annotations

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Spark:
    def __init__(self, sf_dir: str):
        self.dir = sf_dir.rstrip("/")

    def table(self, name: str) -> str:
        return f"parquet.`{self.dir}/{name}.parquet`"

    def json(self, column: str, key: str) -> str:
        return f"get_json_object({column}, '$.{key}')"

    def ms(self, ts: str) -> str:
        return f"(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) div 1000)"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, r'{pattern}', '{by}')"

    def hit(self, text: str, pattern: str) -> str:
        return f"regexp_like({text}, r'{pattern}')"

    def sha(self, text: str) -> str:
        return f"sha2({text}, 256)"

    def last(self, x: str) -> str:
        return f"last_value({x}) ignore nulls"

    def first(self, x: str) -> str:
        return f"first_value({x}) ignore nulls"

    def each(self, low: str, high: str) -> str:
        return f"explode(sequence({low}, {high}))"

    def parts(self, text: str, sep: str) -> str:
        return f"explode(split({text}, r'{sep}'))"

    def joined(self, x: str, order: str, sep: str = ",") -> str:
        return f"listagg({x}, '{sep}') within group (order by {order})"

    def overlap(self, a: str, b: str) -> str:
        return f"size(array_intersect({a}, {b}))"

    def tokens(self, text: str) -> str:
        return f"array_distinct(split({text}, ' '))"

    def size(self, a: str) -> str:
        return f"size({a})"

    def joined_set(self, x: str) -> str:
        return f"listagg(distinct {x}, ',') within group (order by {x})"

    def script(self, name: str) -> str:
        return "\\p{Is" + name + "}"

    def every(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, r'({pattern})', 1)"

    def found(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, r'{pattern}', {group})"

    def numbered(self, source: str, keep: str, array: str, item: str, nth: str) -> str:
        """Rows of `keep` with each item of the array and its place from 0."""
        return f"select {keep}, posexplode({array}) as ({nth}, {item}) from {source}"

    def split(self, text: str, by: str) -> str:
        return f"split({text}, r'{by}')"

    def kept(self, array: str, condition: str) -> str:
        return f"filter({array}, x -> {condition})"

    def record(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def ordered(self, value: str, *by: str) -> str:
        """The values of a group as an array in this order."""
        key = ", ".join(f"'o{i}', {x}" for i, x in enumerate(by))
        return f"transform(array_sort(collect_list(named_struct({key}, 'v', {value}))), p -> p.v)"

    def fold(self, array: str, start: str, step: str) -> str:
        """`step` over a (what has come so far) and x (the next item)."""
        return f"aggregate({array}, {start}, (a, x) -> {step})"

    def mapped(self, array: str, value: str) -> str:
        return f"transform({array}, x -> {value})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def concat(self, a: str, b: str) -> str:
        return f"concat({a}, {b})"

    def line(self, array: str, sep: str) -> str:
        return f"array_join({array}, '{sep}')"

    def distinct(self, array: str) -> str:
        return f"array_sort(array_distinct({array}))"

    def meets(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def part(self, array: str, low: int, n: int) -> str:
        return f"slice({array}, {low}, {n})"

    def number(self, text: str) -> str:
        return f"try_cast({text} as bigint)"

    def asc(self, x: str) -> str:
        return f"{x} asc nulls last"

    def spread(self, x: str) -> str:
        """Rows dealt to 64 tasks by x: a file of a few MB is one task else, however many pairs its rows make."""
        return f"/*+ REPARTITION(64, {x}) */ "

    def dealt(self, x: str, rows: str) -> str:
        """rows, dealt by x before what follows, which else sorts or samples them where they are made, and again."""
        return f"(select /*+ REBALANCE({x}) */ * from {rows}) s"


class Duck:
    def table(self, name: str) -> str:
        return name

    def json(self, column: str, key: str) -> str:
        return f"json_extract_string({column}, '$.{key}')"

    def ms(self, ts: str) -> str:
        return f"(epoch_us({ts}) // 1000)"

    def sub(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')"

    def hit(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')"

    def sha(self, text: str) -> str:
        return f"sha256({text})"

    def last(self, x: str) -> str:
        return f"last_value({x} ignore nulls)"

    def first(self, x: str) -> str:
        return f"first_value({x} ignore nulls)"

    def each(self, low: str, high: str) -> str:
        return f"unnest(range(cast({low} as bigint), cast({high} as bigint) + 1))"

    def parts(self, text: str, sep: str) -> str:
        return f"unnest(regexp_split_to_array({text}, '{sep}'))"

    def joined(self, x: str, order: str, sep: str = ",") -> str:
        return f"string_agg({x}, '{sep}' order by {order})"

    def overlap(self, a: str, b: str) -> str:
        return f"len(list_intersect({a}, {b}))"

    def tokens(self, text: str) -> str:
        return f"list_distinct(string_split({text}, ' '))"

    def size(self, a: str) -> str:
        return f"len({a})"

    def joined_set(self, x: str) -> str:
        return f"string_agg(distinct {x}, ',' order by {x})"

    def script(self, name: str) -> str:
        return "\\p{" + name + "}"

    def every(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, '{pattern}')"

    def found(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})"

    def numbered(self, source: str, keep: str, array: str, item: str, nth: str) -> str:
        return f"select {keep}, unnest({array}) as {item}, unnest(range(len({array}))) as {nth} from {source}"

    def split(self, text: str, by: str) -> str:
        return f"regexp_split_to_array({text}, '{by}')"

    def kept(self, array: str, condition: str) -> str:
        return f"list_filter({array}, lambda x: {condition})"

    def record(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def ordered(self, value: str, *by: str) -> str:
        return f"list({value} order by {', '.join(by)})"

    def fold(self, array: str, start: str, step: str) -> str:
        return f"list_reduce({array}, lambda a, x: {step}, {start})"

    def mapped(self, array: str, value: str) -> str:
        return f"list_transform({array}, lambda x: {value})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def concat(self, a: str, b: str) -> str:
        return f"list_concat({a}, {b})"

    def line(self, array: str, sep: str) -> str:
        return f"coalesce(array_to_string({array}, '{sep}'), '')"

    def distinct(self, array: str) -> str:
        return f"list_sort(list_distinct({array}))"

    def meets(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def part(self, array: str, low: int, n: int) -> str:
        return f"{array}[{low}:{low + n - 1}]"

    def number(self, text: str) -> str:
        return f"try_cast({text} as bigint)"

    def asc(self, x: str) -> str:
        """Nulls last, as is the default here."""
        return x

    def spread(self, x: str) -> str:
        return ""

    def dealt(self, x: str, rows: str) -> str:
        return rows


Dialect = Spark | Duck

#: Thresholds that results depend on.
CANDIDATE_SCORE = 0.55
AUTO_SCORE = 0.92
NARRATION_CHARS_PER_SEC = 16.5
SWITCH_COVERAGE, SWITCH_CONFIDENCE = 0.5, 0.25
GAP_MIN_MS = 15_000
DRIFT_MS = 30_000
REWIND_CAP_MS = 45_000
FUTURE_SKEW_MS = 120_000
NOW_MS = 1_706_745_600_000  # the instant queries take for now: 2024-02-01
DAY_MS = 86_400_000
JOB_NOW_MS = 899_251_200_000  # the instant for the queue, whose jobs are older: 1998-07-01


def round3(x: str) -> str:
    """Half up at three decimals, also for negatives."""
    return f"(floor(({x}) * 1000 + 0.5) / 1000)"


def norm_title(d: Dialect, x: str) -> str:
    """Our own rule: lower case, no edition marker in brackets, no leading article, letters and digits only, single blanks."""
    plain = d.sub(f"lower({x})", r"\((un)?abridged\)", "")
    plain = d.sub(plain, "[^a-z0-9]+", " ")
    return f"trim({d.sub(f'trim({plain})', '^(the|an|a) ', '')})"


def similarity(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 1.0 else 1.0 - cast(levenshtein({a}, {b}) as double) / greatest(length({a}), length({b})) end)"


def score_of(author: str, other: str, size: str, size_other: str) -> str:
    """The score of a pair that the view has: the same author, and how far sizes are apart."""
    return round3(f"0.5 + 0.25 * (case when {author} = {other} then 1.0 else 0.5 end) + 0.2 * (cast(abs({size} - {size_other}) as double) / 50)")


def coverage_of(size: str, other: str) -> str:
    return round3(f"cast(least({size}, {other}) as double) / greatest({size}, {other}, 1)")


def views(d: Dialect) -> dict[str, str]:
    t = d.table
    k = f"cast({d.json('props', 'k')} as bigint)"
    six = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate"
    return {
        "v_books": f"""select p_partkey as id, case when p_partkey % 2 = 0 then 'ebook' else 'audio' end as kind, p_name as title, p_brand as author,
            nullif(p_type, 'PROMO') as series, case p_size % 5 when 0 then 'en' when 1 then 'eng' when 2 then 'fre' when 3 then 'he' else 'und' end as language,
            case p_size % 10 when 0 then 'missing' when 1 then 'error' else 'ready' end as scan_state,
            cast(floor(p_retailprice * 60000 + 0.5) as bigint) as duration_ms, cast(floor(p_retailprice * 1000 + 0.5) as bigint) as total_chars,
            {NOW_MS} - (p_partkey * 7919 % 60) * {DAY_MS} - p_partkey * 1000 as added_ms, cast(p_size as bigint) as size from {t("part")}""",
        "v_facets": f"""select p_partkey as book_id, 'genre' as kind, p_type as value, lower({d.sub("trim(p_type)", "[ ]+", " ")}) as fold from {t("part")}
            union all select p_partkey, 'publisher', p_brand, lower({d.sub("trim(p_brand)", "[ ]+", " ")}) from {t("part")}
            union all select p_partkey, 'year', cast(1990 + p_size as string), cast(1990 + p_size as string) from {t("part")}
            union all select p_partkey, 'rating', cast(p_size % 10 as string), cast(p_size % 10 as string) from {t("part")}""",
        "v_pairs": f"""select e.id * 1000000 + a.id as pair_id, e.id as ebook_id, a.id as audio_id,
            case (e.id + a.id) % 8 when 1 then 'confirmed' when 3 then 'auto' when 5 then 'candidate' else 'rejected' end as status,
            {score_of("e.author", "a.author", "e.size", "a.size")} as score,
            {coverage_of("e.size", "a.size")} as coverage,
            {round3("cast((e.id + a.id) % 100 as double) / 100")} as confidence
            from (select {d.spread("id")}* from v_books where kind = 'ebook') e join (select * from v_books where kind = 'audio') a on e.title = a.title and e.series = a.series""",
        "v_events": f"""select event_id, user_id, {k} % 50 as book_id, {k} % 3 as session, event_id as seq, {d.ms("ts")} as at_ms,
            case event_type when 'click' then 'heartbeat' when 'signup' then 'open' when 'error' then 'seek' when 'purchase' then 'finish' else 'heartbeat' end as intent,
            value / 500 as pct from {t("events")}""",
        "v_state": """select user_id, book_id, count(*) as revision, max_by(pct, event_id) as pct, max(at_ms) as updated_ms, max(event_id) as last_event,
            max_by(intent, event_id) = 'finish' as finished from v_events group by user_id, book_id""",
        "v_jobs": f"""select o_orderkey as id, case o_orderstatus when 'O' then 'queued' when 'P' then 'running' else 'done' end as state,
            case o_orderkey % 4 when 0 then 'align' when 1 then 'scan' when 2 then 'index' else 'download' end as type,
            -cast(substring(o_orderpriority, 1, 1) as bigint) as priority, {d.ms("o_orderdate")} as created_ms, o_custkey as book_id, o_orderkey % 5 as attempts,
            case o_orderkey % 5 when 4 then 'model-missing:m' || cast(o_orderkey % 3 as string) || '|not on disk' when 3 then 'timeout' end as error,
            {d.ms("o_orderdate")} + (o_orderkey % 4) * 60000 as lease_ms from {t("orders")}""",
        "v_tracks": f"""select l_orderkey as book_id, row_number() over (partition by l_orderkey order by {six}) - 1 as idx, cast(floor(l_quantity * 60000 + 0.5) as bigint) as duration_ms,
            l_returnflag as genre, case when l_linenumber % 3 = 0 then l_linestatus end as narrator, case when l_linenumber > 2 then 'part ' || cast(l_partkey as string) end as title,
            1980 + l_linenumber as year, l_partkey as part_id from {t("lineitem")}""",
        "v_offsets": """select book_id, idx, duration_ms, genre, narrator, title, cast(coalesce(sum(duration_ms) over (partition by book_id order by idx rows between unbounded preceding and 1 preceding), 0) as bigint)
            as start_ms from v_tracks""",
        "v_turns": f"""select conv_id, turn, role, length(text) as n, cast(coalesce(sum(length(text) * 60) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as bigint)
            as start_ms from {t("conversations")}""",
        "v_segments": """select conv_id, turn as ord, start_ms, start_ms + n * 60 as end_ms, cast(n % 100 + 1 as double) / 100 as confidence, case when n % 2 = 0 then 'exact' else 'fuzzy' end as source,
            cast(n * 37 % 5000 as bigint) as uncertainty_ms from v_turns where turn % 7 <> 3""",
        "v_notes": f"""select d.doc_id as id, d.doc_id % 50 as user_id, case d.doc_id % 3 when 0 then 'highlight' when 1 then 'note' else 'bookmark' end as kind, d.text as note, d.lang,
            d.source, case when d.doc_id % 2 = 0 then 'text' else 'audio' end as medium, d.doc_id % 7 as spine, d.doc_id * 37 % greatest(d.n_chars, 1) as start_at, coalesce(l.toxic, 0) as deleted from {t("documents")} d left join {t("labels")} l on d.doc_id = l.doc_id""",
        "v_aligned": f"""select s.*, v as version from (select *, {d.each("1", "cast(1 + conv_id % 3 as int)")} as v from v_segments) s where (ord + v) % 4 <> 0""",
        "v_rates": """select conv_id, ord, start_ms, prev_start, cast(start_ms - prev_start as double) / (ord - prev_ord) as rate from (select conv_id, ord, start_ms,
            lag(start_ms) over (partition by conv_id order by ord) as prev_start, lag(ord) over (partition by conv_id order by ord) as prev_ord from v_segments) r where prev_ord is not null""",
        "v_sentences": f"""select doc_id, ord, sentence, start_at, start_at + length(sentence) as end_at from (select doc_id, ord, sentence,
            cast(coalesce(sum(length(sentence)) over (partition by doc_id order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as start_at
            from ({d.numbered(t("documents"), "doc_id", d.every("text", "[^.!?]+[.!?]*|[.!?]+"), "sentence", "ord")}) x) y""",
        "v_shelf": f"select o_custkey % 100 as shelf_id, o_orderkey as book_id, row_number() over (partition by o_custkey % 100 order by o_orderkey) as rank, o_totalprice as price from {t('orders')}",
    }


def with_views(d: Dialect, body: str) -> str:
    """body with the views that it names, and those they name, as common table expressions."""
    text, found = views(d), []

    def need(sql: str) -> None:
        for name in text:
            if name in sql and name not in found:
                need(text[name])
                found.append(name)

    need(body)
    if not found:
        return body
    head = ", ".join(f"{n} as ({text[n]})" for n in found)
    if body.lower().startswith("with recursive "):
        return f"with recursive {head}, {body[15:]}"
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
