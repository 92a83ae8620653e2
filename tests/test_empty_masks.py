"""Queries on tables in which every cell has one flag, quantity and tax, so that masks are empty or full and bands flat."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="session")
def flat(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("flat"))
    row = "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    rows = [(r, c, 1, 1, 50.0, 100.0 + (r * 7 + c * 3) % 11, 0.1, 0.08, "R") for r in range(110, 146) for c in range(110, 146)]
    spark.createDataFrame(rows, row).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def same_as_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet/*.parquet')")
    cursor = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, folder)
    assert got.columns == names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["q_emission", "q_dti_binary", "q_dti_soft", "q_losfo_scores", "q_marginal"])
def test_sums_without_dots_are_those_of_sql(spark, flat, name):
    same_as_sql(spark, flat, name)


def test_ladder_without_dots_has_no_scores(spark, flat):
    got = entry.queries()["q_ladder"](spark, flat).collect()
    assert [r.dots for r in got] == [0] * 5 and all(r.stand_dots > 0 and r.score is None and r.go_on is None for r in got)


def test_a_flat_band_has_no_lines(spark, flat):
    got = entry.queries()["q_lineament"](spark, flat).collect()
    assert len(got) == 36 * 36 and {(r.field, r.score, r.bonus) for r in got} == {(0.0, 0.0, 0.0)}


def test_boosting_with_one_class_gives_its_share(spark, flat):
    assert {r.prob for r in entry.queries()["q_calibrated_boosting"](spark, flat).collect()} == {1.0}
    assert [r.auc for r in entry.queries()["q_oof_boosting"](spark, flat).collect()] == [None]
