import pytest

from stopflow.operators.skew import NO_HOT, HotGroups, hot_groups
from stopflow.operators.visits import CLEAN_COLUMNS, clean_arrivals, stop_dimension
from stopflow.schemas import JOURNEY, QUAYS, STOPS
from stopflow.sources.testdata import _filled

from .cases import arrivals, stopdata, values, visit


@pytest.fixture(params=["window", "chunks"])
def clean(request, spark):
    """Cleaning by windows and by ordered chunks must agree on every case."""

    def run(rows, **kw):
        visits = arrivals(spark, rows)
        hot = NO_HOT
        if request.param == "chunks":
            hot = hot_groups(visits, JOURNEY, min_rows=1)
            assert hot
        return clean_arrivals(visits, stopdata(spark), hot=hot, chunk_rows=2, **kw)

    return run


def kept(df):
    return [r.sequenceNr for r in df.orderBy("sequenceNr", "quay_id").collect()]


def test_columns(clean):
    assert clean([visit(1, "Q1")]).columns == [*CLEAN_COLUMNS, "quay_id"]


def test_second_visit_of_a_quay_is_dropped(clean):
    rows = [visit(1, "Q1"), visit(2, "Q2"), visit(3, "Q3"), visit(5, "Q2")]
    assert kept(clean(rows)) == [1, 2, 3]


@pytest.mark.parametrize("flag", ["extraCall", "estimated", "journeyCancellation", "stopCancellation"])
def test_everything_from_the_first_flag_on_is_dropped(clean, flag):
    rows = [visit(i, f"Q{i}") for i in (1, 2)] + [visit(3, "Q3", **{flag: True}), visit(4, "Q4a"), visit(5, "Q5")]
    assert kept(clean(rows)) == [1, 2]


def test_unknown_flag_drops_rows_until_it_is_known(clean):
    rows = [visit(1, "Q1", estimated=None), visit(2, "Q2", estimated=None), visit(3, "Q3"), visit(4, "Q4a", estimated=None)]
    assert kept(clean(rows)) == [3, 4]


def test_equal_numbers_share_the_flag(clean):
    rows = [visit(1, "Q1"), visit(2, "Q2"), visit(2, "Q3", estimated=True)]
    assert kept(clean(rows)) == [1]


def test_stop_id_stands_for_all_its_quays(clean):
    rows = [visit(1, "Q1"), visit(2, "S4")]
    assert kept(clean(rows)) == [1, 2, 2]


def test_unknown_stop_is_dropped(clean):
    assert kept(clean([visit(1, "Q1"), visit(2, "nowhere")])) == [1]


@pytest.mark.parametrize("came,expected", [(300 + 7200, [1, 2]), (300 + 7201, [1])])
def test_jump_limit(clean, came, expected):
    rows = [visit(1, "Q1", 0, 0), visit(2, "Q2", 300, came)]
    assert kept(clean(rows, max_delay=10_000)) == expected


@pytest.mark.parametrize("late,expected", [(7199, [1, 2]), (7200, [1])])
def test_delay_limit(clean, late, expected):
    rows = [visit(1, "Q1", 0, 0), visit(2, "Q2", 300, 300 + late)]
    assert kept(clean(rows, max_jump=10_000)) == expected


def test_dropped_rows_still_count_as_previous(clean):
    # the visit at 2 is dropped for its delay; the jump of 3 is measured from it
    rows = [visit(1, "Q1", 0, 0), visit(2, "Q2", 300, 300 + 9000), visit(3, "Q3", 600, 700)]
    assert kept(clean(rows)) == [1]


def test_delay_falls_back_to_departure(clean):
    row = visit(1, "Q1", 0, 0, arrivalTime=None, aimedArrivalTime=None)
    assert kept(clean([row])) == [1]


def test_rows_without_journey_form_one_group(clean):
    rows = [visit(1, "Q1", serviceJourneyId=None), visit(2, "Q2", serviceJourneyId=None, extraCall=True),
            visit(3, "Q3", serviceJourneyId=None)]
    assert kept(clean(rows)) == [1]


def test_row_order_does_not_matter(clean):
    rows = [visit(i, q) for i, q in enumerate(("Q1", "Q2", "S4", "Q3", "Q5"), 1)]
    cols = ["sequenceNr", "quay_id", "stop", "arrivalTime"]
    assert values(clean(rows), *cols) == values(clean(rows[::-1]), *cols)


def test_stop_position_wins_over_quay(spark):
    stops = _filled(spark.createDataFrame(
        [("S1", "Stop", 1.0, 2.0), ("S2", None, None, None)],
        "id string, name string, location_latitude double, location_longitude double"), STOPS)
    quays = _filled(spark.createDataFrame(
        [("Q1", "S1", "Quay", 9.0, 9.0), ("Q2", "S2", "Quay", 8.0, 7.0), ("Q3", "none", "Quay", 0.0, 0.0)],
        "id string, stopPlaceRef string, name string, location_latitude double, location_longitude double"), QUAYS)
    assert values(stop_dimension(stops, quays), "quay_id", "stop_id", "lat", "lon", "name") == [
        ("Q1", "S1", 1.0, 2.0, "Stop"), ("Q2", "S2", 8.0, 7.0, "Quay")]


def test_empty_hot_list_is_false():
    assert not HotGroups() and HotGroups((1,), 1)
