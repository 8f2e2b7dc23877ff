import datetime as dt

from hirelake.operators import kpis, metrics
from hirelake.spec import HIRES, SPECS, DEPARTMENTS, JOBS

D = dt.datetime


def star(spark):
    deps = spark.createDataFrame([(1, "Staff"), (2, "Sales"), (3, "Staff"), (4, "Empty")],
                                 SPECS[DEPARTMENTS].schema)
    jobs = spark.createDataFrame([(10, "Recruiter"), (20, "Manager")], SPECS[JOBS].schema)
    hires = spark.createDataFrame([
        (1, "a", D(2021, 1, 5), 1, 10), (2, "b", D(2021, 4, 5), 3, 10),   # same name, other id
        (3, "c", D(2021, 12, 31, 23, 59, 59), 2, 20), (4, "d", D(2022, 1, 1), 2, 20),
        (5, "e", D(2021, 7, 1), None, 10), (6, "f", None, 1, 10), (7, "g", D(2021, 8, 1), 9, 20),
        (8, "h", D(2021, 10, 1), 2, None), (9, "i", D(2021, 2, 1), 2, 20),
    ], SPECS[HIRES].schema)
    return hires, deps, jobs


def test_quarterly_inner_merges_equal_names(spark):
    hires, deps, jobs = star(spark)
    got = [tuple(r) for r in metrics.quarterly_hires(hires, deps, jobs, 2021).collect()]
    assert got == [("Sales", "Manager", 1, 0, 0, 1), ("Staff", "Recruiter", 1, 1, 0, 0)]


def test_quarterly_left_labels_missing(spark):
    hires, deps, jobs = star(spark)
    got = [tuple(r) for r in metrics.quarterly_hires(hires, deps, jobs, 2021, include_nulls=True).collect()]
    assert got == [("Sales", "Manager", 1, 0, 0, 1), ("Sales", "Sin asignar", 0, 0, 0, 1),
                   ("Sin asignar", "Manager", 0, 0, 1, 0), ("Sin asignar", "Recruiter", 0, 0, 1, 0),
                   ("Staff", "Recruiter", 1, 1, 0, 0)]
    # every dated hire of the year is counted once
    total = kpis.quarter_totals(metrics.quarterly_hires(hires, deps, jobs, 2021, include_nulls=True))
    assert total.first().total == 7


def test_above_average_counts_empty_departments(spark):
    hires, deps, _ = star(spark)
    per = {r.id: r.hired for r in metrics.hires_per_department(hires, deps, 2021).collect()}
    assert per == {1: 1, 2: 3, 3: 1, 4: 0}
    got = [tuple(r) for r in metrics.above_average(hires, deps, 2021).collect()]
    assert got == [(2, "Sales", 3)]       # mean 1.25; equal names kept apart by id


def test_kpis_peak_tie_earliest(spark):
    q = spark.createDataFrame([("a", "x", 2, 5, 5, 1)], "department string, job string, q1 bigint, "
                              "q2 bigint, q3 bigint, q4 bigint")
    k = kpis.quarter_kpis(q).first()
    assert (k.total, k.peak_quarter, k.peak_hires, k.variation, k.variation_label) == (13, "Q2", 5, -1, "-1")
    share = {r.quarter: r.share for r in kpis.quarter_share(q).collect()}
    assert abs(sum(share.values()) - 1) < 1e-12


def test_top_groups_ties_keep_report_order(spark):
    rows = [(f"d{i % 3}", f"j{i}", 1, 0, 0, 0) for i in range(15)]
    q = spark.createDataFrame(rows, "department string, job string, q1 bigint, q2 bigint, q3 bigint, q4 bigint")
    top = [(r.position, r.department, r.job) for r in kpis.top_groups(q).orderBy("position").collect()]
    expected = sorted((d, j) for d, j, *_ in rows)[:10]
    assert [(d, j) for _, d, j in top] == expected and [p for p, *_ in top] == list(range(1, 11))


def test_quarter_sums_equal_fact_rows_of_the_year(spark):
    from pyspark.sql import functions as F

    from hirelake.functions.scalar import year_range
    from hirelake.plans.tables import LINEITEM_STAR, lineitem_with_null_keys, table
    sf = "/root/testdata/sf0.001"
    li, sup, part = lineitem_with_null_keys(spark, sf), table(spark, sf, "supplier"), table(spark, sf, "part")
    for year in (1994, 1996, 1998):
        of_year = li.where(year_range("l_shipdate", year))
        joined = (of_year.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
                  .join(part, F.col("l_partkey") == F.col("p_partkey")).count())
        inner = kpis.quarter_totals(metrics.quarterly_hires(li, sup, part, year, LINEITEM_STAR)).first()
        outer = kpis.quarter_totals(metrics.quarterly_hires(li, sup, part, year, LINEITEM_STAR,
                                                            include_nulls=True)).first()
        assert inner.total == joined
        assert outer.total == of_year.count()
