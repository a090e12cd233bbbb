"""Partitions exchanged in one step, and directions that turn when a late day comes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stopflow.plans import etl
from stopflow.schemas import LEGS, TABLES
from stopflow.sources import ingest, tables as io, versions
from stopflow.sources.shared import names_in

from .cases import values

D1, D2, D3 = date(2024, 1, 1), date(2024, 1, 2), date(2024, 1, 3)


def legs(spark, days):
    """One leg a day, told apart by its number."""
    rows = spark.createDataFrame(days, "operatingDate date, sequenceNr bigint")
    return rows.select(*[
        F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in LEGS
    ])


def held(spark, root):
    return values(io.read_table(spark, root, "legs"), "operatingDate", "sequenceNr")


def test_readers_see_all_of_an_exchange_or_nothing(spark, tmp_path):
    root = str(tmp_path)
    io.save_partitions(legs(spark, [(D1, 1), (D2, 1)]), root, "legs")
    before = io.read_table(spark, root, "legs")
    number, folder = versions.staging(spark, f"{root}/legs")
    io.write_partitions(legs(spark, [(D2, 2), (D3, 2)]), folder, "operatingDate")
    assert held(spark, root) == [(D1, 1), (D2, 1)]
    versions.exchange(spark, f"{root}/legs", "operatingDate", number, [D1, D2])
    assert held(spark, root) == [(D2, 2), (D3, 2)]
    assert io.partition_values(spark, root, "legs", "operatingDate") == [D2, D3]
    assert values(before, "operatingDate", "sequenceNr") == [(D1, 1), (D2, 1)]  # a reader that began before
    assert values(io.read_days(spark, root, "legs", [D3, D1]), "operatingDate", "sequenceNr") == [(D3, 2)]
    assert io.read_days(spark, root, "legs", [D1]).columns == LEGS.fieldNames()


def test_a_write_that_breaks_off_loses_nothing(spark, tmp_path):
    root = str(tmp_path)
    io.save_partitions(legs(spark, [(D1, 1), (D2, 1)]), root, "legs")
    bad = legs(spark, [(D2, 2)]).withColumn("sequenceNr", F.raise_error(F.lit("lost")).cast("bigint"))
    with pytest.raises(Exception, match="lost"):
        io.save_partitions(bad, root, "legs")
    assert held(spark, root) == [(D1, 1), (D2, 1)]
    for n in (3, 4, 5):
        io.save_partitions(legs(spark, [(D2, n)]), root, "legs")
    assert held(spark, root) == [(D1, 1), (D2, 5)]
    io.drop_partitions(spark, root, "legs", [D1])
    io.drop_partitions(spark, root, "legs", [D3])
    assert held(spark, root) == [(D2, 5)]
    kept = [n for n in names_in(spark, f"{root}/legs") if n.startswith("version=")]
    assert len(kept) == 1 and len([n for n in names_in(spark, f"{root}/legs/_manifest") if n.isdigit()]) == 2


def test_tables_without_manifests_are_taken_over(spark, tmp_path):
    root = str(tmp_path)
    io.write_partitions(legs(spark, [(D1, 1), (D2, 1)]), f"{root}/legs", "operatingDate")
    assert held(spark, root) == [(D1, 1), (D2, 1)]
    io.save_partitions(legs(spark, [(D2, 2)]), root, "legs")
    assert held(spark, root) == [(D1, 1), (D2, 2)]


JAN, FEB, END = date(2024, 1, 29), date(2024, 2, 1), date(2024, 2, 4)


def fill(tables, root, start, end):
    ingest.ingest_dim(tables.stops, root, "stops")
    ingest.ingest_dim(tables.quays, root, "quays")
    ingest.ingest_days(tables.arrivals, root, start, end)


def all_legs(spark, root):
    return values(io.read_table(spark, root, "legs"), *TABLES["legs"].fieldNames())


def test_late_first_days_turn_the_directions_of_later_ones(spark, tables, tmp_path, monkeypatch):
    once, late = str(tmp_path / "once"), str(tmp_path / "late")
    fill(tables, once, JAN, END)
    etl.run(spark, once)
    fill(tables, late, FEB, END)
    etl.run(spark, late)
    february = {r[0] for r in all_legs(spark, late)}
    before = all_legs(spark, late)
    fill(tables, late, JAN, END)
    mended = []
    keep = etl.repair_directions

    def watched(*a):
        mended.extend(keep(*a))

    monkeypatch.setattr(etl, "repair_directions", watched)
    # The run breaks off after the directions have been mended and before they are noted.
    monkeypatch.setattr(etl, "write_ready", lambda *a: (_ for _ in ()).throw(RuntimeError("broken off")))
    with pytest.raises(RuntimeError, match="broken off"):
        etl.run(spark, late)
    monkeypatch.undo()
    etl.run(spark, late)
    want = all_legs(spark, once)
    assert all_legs(spark, late) == want
    assert [r for r in want if r[0] in february] != before  # something did turn
    assert etl.pending_months(spark, late) == []
    for name in ("leg_stats", "route_name"):
        assert values(io.read_table(spark, late, name), *TABLES[name].fieldNames()) == values(
            io.read_table(spark, once, name), *TABLES[name].fieldNames())
