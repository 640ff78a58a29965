"""The queries over pairs of books on odd and crowded shelves: against their SQL, and by the rows their plans make."""

import duckdb
import pytest

from lectern import plans
from lectern.sources import views

from .conftest import SMALL
from .test_plans import key, plain

EVENTS = f"{SMALL}/events.parquet"
#: Of best pairs, and of listings that show them.
BEST = ["join_12_best_pair", "agg_14_auto_shelves", "agg_26_library_stats", "flt_04_paired", "flagship_library", "flt_07_both_formats", "flt_05_in_progress", "flt_06_finished", "ord_02_author", "prj_01_summary"]
CROWD = "select i::bigint as p_partkey, 'red ring' as p_name, 'Brand#' || (i * 7 % 5) as p_brand, 'SMALL' as p_type, (i * 31 % 50)::int as p_size, 900.0 + i % 1000 as p_retailprice from range(3000) r(i)"
#: Few titles, series and authors; ids below 0 and without a status, values that are missing or far out; no id twice.
ODD = """select case when i < 40 then i - 20 when i = 40 then null else i * 3 end::bigint as p_partkey, case i % 11 when 0 then null when 1 then '' else ['red ring', 'The Red Ring', 'red  bolt', 'old bolt'][i % 4 + 1] end as p_name,
    case when i % 13 <> 0 then 'Brand#' || (i * 7 % 4) end as p_brand, [null, 'PROMO', 'SMALL', 'SMALL', 'LARGE'][i % 5 + 1] as p_type,
    case when i % 9 = 0 or i > 290 then null when i % 50 = 7 then 2000000000 else i * 31 % 50 end::int as p_size, 900.0 + (i * i) % 1500 as p_retailprice from range(300) r(i)"""


def shelf(folder, sql):
    """A folder with these parts and the smallest events, and an engine that has both."""
    con = duckdb.connect()
    con.sql(f"copy ({sql}) to '{folder}/part.parquet' (format parquet)")
    con.sql(f"copy (select * from '{EVENTS}') to '{folder}/events.parquet' (format parquet)")
    for t in ("part", "events"):
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return str(folder), con


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return shelf(tmp_path_factory.mktemp("odd"), ODD)


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    return shelf(tmp_path_factory.mktemp("crowd"), CROWD)


def rows(spark, df, metric="number of output rows"):
    """Rows of df, and the most that a node of its plan made by this metric."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = df.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    made = [0]
    runs = store.executionsList()
    for i in range(before, runs.size()):
        run = runs.apply(i)
        values = store.executionMetrics(run.executionId())
        for j in range(run.metrics().size()):
            m = run.metrics().apply(j)
            if m.name() == metric and values.contains(m.accumulatorId()):
                made.append(int(values.apply(m.accumulatorId()).replace(",", "")))
    return got, max(made)


def check(spark, shelf, name):
    folder, con = shelf
    df = plans.queries()[name](spark, folder)
    got, made = rows(spark, df)
    rel = con.sql(plans.oracle_sql()[name])
    at = [rel.columns.index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    assert sorted((tuple(plain(v) for v in r) for r in got), key=key) == want
    return len(want), made


@pytest.mark.parametrize("name", BEST)
def test_best_pairs_of_odd_books(spark, odd, name):
    check(spark, odd, name)


@pytest.mark.parametrize("name", BEST)
def test_best_pairs_list_no_pairs(spark, crowd, name):
    """3,000 books of one title and series are 2,250,000 pairs."""
    _, made = check(spark, crowd, name)
    assert made <= 10 * 3000


#: Listings whose best pairs are scored once for the books of one author and size.
LISTED = ["flt_04_paired", "flagship_library", "flt_07_both_formats"]


@pytest.mark.parametrize("name", LISTED)
def test_best_pairs_list_no_candidates(spark, crowd, name):
    """No node makes several rows of a book; a sort runs what it reads twice."""
    _, made = check(spark, crowd, name)
    assert made <= 2 * 3000


@pytest.mark.parametrize("name", ["flagship_library", "flt_07_both_formats"])
def test_listings_of_repeated_books(spark, repeated, name):
    check(spark, repeated, name)


def nodes(spark, shelf, name):
    """The plan as it ran."""
    df = plans.queries()[name](spark, shelf[0])
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def test_flagship_reads_books_few_times(spark, crowd):
    """Once for what is listed and once for the best pairs; ids below 0, of which there are none, need no more."""
    found = nodes(spark, crowd, "flagship_library")
    assert sum("FileScan parquet [p_partkey" in x for x in found) <= 2


@pytest.mark.parametrize("name", ["flt_05_in_progress", "flt_06_finished"])
def test_listings_without_pairs_read_books_once(spark, crowd, name):
    assert sum("FileScan parquet [p_partkey" in x for x in nodes(spark, crowd, name)) == 1


def test_both_formats_sorts_pairs_once(spark, odd):
    """Pairs are dealt before they are sorted for the first book of each."""
    found = nodes(spark, odd, "flt_07_both_formats")
    dealt = next(i for i, x in enumerate(found) if "Exchange hashpartitioning(pair_id" in x)
    assert not [x for x in found[dealt:] if "WindowGroupLimit" in x]


#: Of scores of candidates.
SCAN = ["math_03_pair_score"]


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Odd books, some ids twice, with other titles, sizes and states."""
    return shelf(tmp_path_factory.mktemp("repeated"), f"{ODD} union all select p_partkey, case when p_partkey % 4 = 0 then 'red ring' else p_name end, p_brand, p_type, p_size + p_partkey % 3, p_retailprice from ({ODD}) o where p_partkey % 15 = 0")


@pytest.mark.parametrize("name", SCAN)
def test_scores_of_odd_and_repeated_books(spark, odd, repeated, name):
    check(spark, odd, name)
    check(spark, repeated, name)


@pytest.mark.parametrize("name", SCAN)
def test_scores_send_no_pairs(spark, crowd, name):
    """1,440,000 pairs of 3,000 books, of which shuffles take books only."""
    _, sent = rows(spark, plans.queries()[name](spark, crowd[0]).selectExpr("sum(ebook_id + audio_id)", "sum(score)"), "shuffle records written")
    assert 0 < sent <= 10 * 3000


#: Every pair is a row of these.
WHOLE = ["agg_22_pair_key", "prj_11_evidence"]


@pytest.mark.parametrize("name", WHOLE)
def test_pairs_are_made_in_many_tasks(spark, odd, name):
    check(spark, odd, name)
    assert "REPARTITION_BY_NUM" in plans.queries()[name](spark, odd[0])._jdf.queryExecution().executedPlan().toString()


#: Of keys of pairs, each looked up among the pairs.
KEYS = ["join_23_import_outcome"]


@pytest.mark.parametrize("name", KEYS)
def test_outcomes_of_odd_and_repeated_books(spark, odd, repeated, name):
    check(spark, odd, name)
    check(spark, repeated, name)


@pytest.mark.parametrize("name", KEYS)
def test_outcomes_of_keys_that_pairs_have(spark, odd, repeated, monkeypatch, name):
    """Audiobooks of even and odd ids and of ids side by side, as no table makes them."""
    texts = views.views
    for ebooks in ("p_partkey % 5 in (0, 1, 3)", "p_partkey % 5 in (0, 2)"):
        monkeypatch.setattr(views, "views", lambda d, by=ebooks: {k: v.replace("p_partkey % 2 = 0", by) for k, v in texts(d).items()})
        for folder in (odd, repeated):
            check(spark, folder, name)
            found = {r.outcome for r in plans.queries()[name](spark, folder[0]).collect()}
            assert found == {"unmatched", "already", "imported"}


@pytest.mark.parametrize("name", KEYS)
def test_outcomes_send_no_pairs(spark, crowd, name):
    """2,250,000 pairs of 3,000 books, of which shuffles take books only."""
    got, sent = rows(spark, plans.queries()[name](spark, crowd[0]).selectExpr("count(*)", "sum(length(pair_key))", "count_if(outcome = 'unmatched')"), "shuffle records written")
    assert tuple(got[0]) == (2_250_000, 24 * 2_250_000, 2_250_000)
    assert 0 < sent <= 10 * 3000
