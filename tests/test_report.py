"""Report layer: parameter checks, display order, column filters."""

import pytest

from maternis.operators.search import filter_column
from maternis.plans import report as RP


def test_parameters_are_checked(spark):
    p = RP.ReportParams
    for bad in (p(year=2022, level=RP.REGIONAL, region="Sul"), p(year=2022, level=RP.STATE), p(year=2022, level="x"),
                p(year=2022, level=RP.MUNICIPAL, state="A"), p(), p(years=(2023, 2022)), p(year=1, age_range=(49, 10))):
        with pytest.raises(ValueError):
            RP.check_params(bad, RP.COUNT_LEVELS, None)
    RP.check_params(p(year=2022, level=RP.REGIONAL, region="Sul"), (RP.REGIONAL,), None)
    assert RP.empty_choices(p(year=1, races=(), periods=("x",))) == ["races"]
    with pytest.raises(ValueError):
        RP.report_table(spark.range(1), RP.REGIONAL)
    assert not RP.has_rows(spark.range(0)) and RP.has_rows(spark.range(1))


def test_display_order_and_filter(spark):
    rows = [("b", "x", 1), ("a", None, 2), (None, "y", 3), ("a", "Z", 4)]
    df = spark.createDataFrame(rows, "capitulo_cid10 string, causabas_categoria string, obitos int")
    assert [r.obitos for r in RP.sorted_table(df).collect()] == [4, 2, 1, 3]
    assert [r.obitos for r in RP.sorted_table(df, ("obitos",), ("obitos",)).collect()] == [4, 3, 2, 1]
    with pytest.raises(ValueError):
        RP.sorted_table(df, ("nope",))
    assert [r.obitos for r in filter_column(df, "causabas_categoria", "z").collect()] == [4]
    assert RP.uf_table(spark.createDataFrame([("A", 2022)], "uf string, ano int")).columns == ["uf"]
