"""Parameterised reports over the marts: filter -> group -> sum.

A report is a plain function ``(mart, params) -> DataFrame``; the level
(national / regional / state / municipal) is dispatched in Python while the
plan is built, so every shape is a single declarative plan. Year and age are
range filters on partition/data columns and reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import classify as C
from ..operators.dims import bounded_broadcast

NATIONAL, REGIONAL, STATE, MUNICIPAL = "Nacional", "Regional", "Estadual", "Municipal"
ALL_REGIONS_COUNT = 5
ALL_REGIONS_LABEL = "Todas"
ALL_COMMITTEE = (S.YES, S.NO, S.NO_INFO)


@dataclass(frozen=True)
class ReportParams:
    """Report parameters.

    A list parameter of ``None`` means "every value the mart has", which (as a
    choice list built from the sorted distinct values) never includes null.
    An empty tuple selects nothing. ``regions`` of ``None`` or of five entries
    means the whole country: no region filter at all.
    """
    year: int | None = None
    years: tuple[int, int] | None = None
    level: str = NATIONAL
    regions: tuple[str, ...] | None = None
    region: str | None = None
    state: str | None = None
    municipality: str | None = None
    age_range: tuple[int, int] = (10, 49)
    races: tuple[str, ...] | None = None
    cause_types: tuple[str, ...] | None = None
    periods: tuple[str, ...] | None = None
    committee: tuple[str, ...] | None = field(default=ALL_COMMITTEE)
    exclude_external: bool = False

    @property
    def all_regions(self) -> bool:
        return self.regions is None or len(self.regions) == ALL_REGIONS_COUNT


COUNT_LEVELS = (NATIONAL, STATE, MUNICIPAL)


def check_params(p: ReportParams, levels: tuple[str, ...], states: DataFrame | None) -> None:
    """Raise ``ValueError`` for parameters that no report can answer."""
    if p.level not in levels:
        raise ValueError(f"level {p.level!r}: this report has {', '.join(levels)}")
    if p.level in (STATE, MUNICIPAL) and (states is None or not p.state):
        raise ValueError(f"level {p.level!r} needs the state table and a state")
    if p.level == MUNICIPAL and not p.municipality:
        raise ValueError("level 'Municipal' needs a municipality")
    if p.level == REGIONAL and not p.region:
        raise ValueError("level 'Regional' needs a region")
    if p.year is None and p.years is None:
        raise ValueError("a report needs a year or a range of years")
    for name, bounds in (("years", p.years), ("age_range", p.age_range)):
        if bounds is not None and bounds[0] > bounds[1]:
            raise ValueError(f"{name} {bounds}: the first bound is above the second")


def empty_choices(p: ReportParams) -> list[str]:
    """Names of the choice lists from which nothing is chosen: the report is empty before any job runs."""
    return [c for c in ("regions", "races", "cause_types", "periods", "committee") if getattr(p, c) == ()]


def has_rows(report: DataFrame) -> bool:
    """Whether a report has anything to show (reads one row)."""
    return not report.isEmpty()


def sorted_table(table: DataFrame, by: tuple[str, ...] = ("capitulo_cid10", "causabas_categoria"),
                 descending: tuple[str, ...] = ()) -> DataFrame:
    """A display table in the order of the columns ``by`` (the view's default order, or any the reader
    clicks); nulls come last, and ties follow the other columns, so that the order is the same every time."""
    missing = [c for c in by if c not in table.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    rest = [c for c in table.columns if c not in by]
    return table.orderBy(*[F.col(c).desc_nulls_last() if c in descending else F.col(c).asc_nulls_last() for c in by],
                         *[F.col(c).asc_nulls_last() for c in rest])


def in_choice(c: str, values: tuple | None) -> Column:
    """Membership in a choice list; ``None`` = all non-null values; () = nothing."""
    col = F.col(c)
    if values is None:
        return col.isNotNull()
    if len(values) == 0:
        return F.lit(False)
    return col.isin(*values)


def state_code(states: DataFrame, state_name: str) -> DataFrame:
    """One-column frame ``uf`` with the abbreviation(s) of a state given by full name."""
    return (states.where(F.col("uf") == state_name)
            .select(F.col("sigla_uf").alias("uf")).distinct())


def where_state(df: DataFrame, states: DataFrame, state_name: str) -> DataFrame:
    """uf = abbreviation of ``state_name``, as a semi-join with the (tiny) lookup result."""
    return df.join(bounded_broadcast(state_code(states, state_name)), on="uf", how="left_semi")


def common_filter(df: DataFrame, p: ReportParams, with_cause_type: bool, with_committee: bool = True) -> DataFrame:
    cond = F.lit(True)
    if p.year is not None:
        cond = cond & (F.col("ano") == p.year)
    if p.years is not None:
        cond = cond & F.col("ano").between(*p.years)
    if with_cause_type:
        cond = cond & in_choice("tipo_de_morte_materna", p.cause_types)
    cond = cond & in_choice("periodo_do_obito", p.periods)
    if with_committee:
        cond = cond & in_choice("investigacao_cmm", p.committee)
    cond = cond & in_choice("racacor", p.races)
    cond = cond & F.col("idade").between(*p.age_range)
    return df.where(cond)


def level_filter(df: DataFrame, p: ReportParams, states: DataFrame | None, always_filter_regions: bool = False) -> DataFrame:
    """National (all or some regions), regional, state or municipal restriction."""
    if p.level == NATIONAL:
        if p.all_regions and not always_filter_regions:
            return df
        return df.where(in_choice("regiao", p.regions))
    if p.level == REGIONAL:
        return df.where(F.col("regiao") == p.region)
    if p.level == STATE:
        return where_state(df, states, p.state)
    if p.level == MUNICIPAL:
        return where_state(df.where(F.col("municipio") == p.municipality), states, p.state)
    raise ValueError(f"unknown level {p.level!r}")


def _report(mart: DataFrame, p: ReportParams, states: DataFrame | None, attrs: list[str],
            with_cause_type: bool) -> DataFrame:
    check_params(p, COUNT_LEVELS, states)
    df = common_filter(mart, p, with_cause_type)
    df = level_filter(df, p, states)
    if p.level == NATIONAL and p.all_regions:
        df = df.withColumn("regiao", F.lit(ALL_REGIONS_LABEL))
        keys = ["ano", "regiao"]
    elif p.level == NATIONAL:
        keys = ["regiao", "ano"]
    elif p.level == STATE:
        keys = ["uf", "regiao", "ano"]
    else:
        keys = ["municipio", "uf", "regiao", "ano"]
    return df.groupBy(*keys, *attrs).agg(F.sum(F.col("obitos").cast("long")).alias("obitos"))


OM_ATTRS = ["capitulo_cid10", "causabas_categoria", "tipo_de_morte_materna", "periodo_do_obito",
            "racacor", "investigacao_cmm"]
ONM_ATTRS = ["capitulo_cid10", "causabas_categoria", "periodo_do_obito", "racacor", "investigacao_cmm"]


def maternal_report(mart: DataFrame, p: ReportParams, states: DataFrame | None = None) -> DataFrame:
    """Official (or garbage-code) maternal deaths report."""
    return _report(mart, p, states, OM_ATTRS, with_cause_type=True)


def not_considered_report(mart: DataFrame, p: ReportParams, states: DataFrame | None = None) -> DataFrame:
    """Not-considered deaths report; optionally without chapter XX (exact match:
    a null chapter is dropped too when the option is on)."""
    check_params(p, COUNT_LEVELS, states)
    if p.exclude_external:
        mart = mart.where(~C.is_external_chapter())
    df = common_filter(mart, p, with_cause_type=False)
    df = level_filter(df, p, states)
    if p.level == NATIONAL and p.all_regions:
        df = df.withColumn("regiao", F.lit(ALL_REGIONS_LABEL))
        keys = ["ano", "regiao"]
    elif p.level == NATIONAL:
        keys = ["ano", "regiao"]
    elif p.level == STATE:
        keys = ["ano", "uf", "regiao"]
    else:
        keys = ["ano", "municipio", "uf", "regiao"]
    return df.groupBy(*keys, *ONM_ATTRS).agg(F.sum(F.col("obitos").cast("long")).alias("obitos"))


def uf_report(mart_uf: DataFrame, year: int, age_range: tuple[int, int] = (10, 49)) -> DataFrame:
    """State table: all nine counts summed by state, region and year."""
    df = mart_uf.where((F.col("ano") == year) & F.col("idade").between(*age_range))
    return df.groupBy("uf", "regiao", "ano").agg(
        *[F.sum(c).cast("long").alias(c) for c in S.UF_COUNT_COLUMNS])


LEVEL_DROPS = {
    NATIONAL: ["ano", "regiao"],
    STATE: ["uf", "regiao", "ano"],
    MUNICIPAL: ["municipio", "uf", "regiao", "ano"],
}


def report_table(report: DataFrame, level: str) -> DataFrame:
    """Display projection: the geography and year columns fixed by the level are dropped."""
    if level not in LEVEL_DROPS:
        raise ValueError(f"level {level!r}: display tables have {', '.join(LEVEL_DROPS)}")
    return report.drop(*LEVEL_DROPS[level])


def uf_table(report: DataFrame) -> DataFrame:
    """Display projection of the state report: every column but the year."""
    return report.drop("ano")
