"""Classification predicates and derived labels (pure Column builders).

ICD-10 codes are compared as text: for upper-case letter + digit codes the
binary order is the order the rules are written in. Three-character codes such
as ``B20`` sort below ``B200`` and so fall outside ``B200..B249`` on purpose.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _between(c: Column, lo: str, hi: str) -> Column:
    return (c >= lo) & (c <= hi)


def maternal_type(cause: Column | str = "causabas") -> Column:
    """Indireta / Não especificada / Direta; null cause -> null."""
    c = _c(cause)
    indirect = (
        _between(c, "B200", "B249")
        | _between(c, "O100", "O109")
        | ((c >= "O240") & (c != "O244") & (c <= "O259"))
        | (c == "O94")
        | _between(c, "O980", "O999")
    )
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(indirect, F.lit(S.TYPE_INDIRECT))
        .when(c == "O95", F.lit(S.TYPE_UNSPECIFIED))
        .otherwise(F.lit(S.TYPE_DIRECT))
    )


def death_period(pregnancy: Column | str = "obitograv", puerperium: Column | str = "obitopuerp") -> Column:
    """Period of death from the two filled codes; the first matching rule wins."""
    g, p = _c(pregnancy), _c(puerperium)
    return (
        F.when((g == "1") & (p != "1") & (p != "2"), F.lit(S.PERIOD_PREGNANCY))
        .when((g != "1") & (p == "1"), F.lit(S.PERIOD_PUERPERIUM_42))
        .when((g != "1") & (p == "2"), F.lit(S.PERIOD_PUERPERIUM_1Y))
        .when(((g == "2") & p.isin("3", "9")) | ((g == "9") & (p == "3")), F.lit(S.PERIOD_NEITHER))
        .when((g == "9") & (p == "9"), F.lit(S.PERIOD_NOT_INFORMED))
        .when((g == "1") & p.isin("1", "2"), F.lit(S.PERIOD_INCONSISTENT))
        .otherwise(F.lit(None).cast("string"))
    )


#: Codes outside chapter O that are maternal under a condition: first and last code, and whether the death must be
#: one in pregnancy or early puerperium (else: not one in late puerperium).
CONDITIONAL_CAUSES = [("A34", "A34", False), ("B200", "B249", True), ("D392", "D392", True), ("E230", "E230", True),
                      ("F530", "F539", False), ("M830", "M830", False)]


def maternal_cause(cause: Column | str = "causabas", pregnancy: Column | str = "obitograv",
                   puerperium: Column | str = "obitopuerp") -> Column:
    """Cause clause of the official maternal-death definition.

    Code tests are null-safe (``<=>``), so the clause gives the same answer on
    the raw codes as on the recoded/filled ones: the O935/O937 -> O95 recode
    stays inside O000..O959, and the fills only turn null/0/4/8 into 9, never
    into 1 or 2. It can therefore be evaluated before any recode, and a filter
    on it reaches the scan. A null cause gives null (three-valued), so the row
    is dropped both by F1 and by its negation.

    The conditional codes are a table of rules, not a chain of tests: spelled out, the clause and the operators
    around it make one generated method of more than 8,000 bytes, which the JVM interprets.
    """
    c, g, p = _c(cause), _c(pregnancy), _c(puerperium)
    pregnant_or_early = g.eqNullSafe("1") | p.eqNullSafe("1")
    not_late = ~p.eqNullSafe("2")
    rules = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(early).alias("early"))
                      for lo, hi, early in CONDITIONAL_CAUSES])
    return (
        _between(c, "O000", "O959")
        | _between(c, "O980", "O999")
        | F.exists(rules, lambda r: (c >= r["lo"]) & (c <= r["hi"])
                   & ((r["early"] & pregnant_or_early) | (~r["early"] & not_late)))
    )


def is_female(sex: Column | str = "sexo") -> Column:
    return _c(sex) == "2"


def is_maternal(cause="causabas", pregnancy="obitograv", puerperium="obitopuerp", sex="sexo") -> Column:
    """female and the maternal cause clause (raw or recoded codes alike)."""
    return is_female(sex) & maternal_cause(cause, pregnancy, puerperium)


def is_not_considered(cause="causabas", pregnancy="obitograv", puerperium="obitopuerp", sex="sexo") -> Column:
    """female, died pregnant or in the puerperium, cause not maternal
    (raw or recoded codes alike)."""
    g, p = _c(pregnancy), _c(puerperium)
    return (is_female(sex) & (g.eqNullSafe("1") | p.eqNullSafe("1") | p.eqNullSafe("2"))
            & ~maternal_cause(cause, pregnancy, puerperium))


def raw_candidate(cause="causabas", pregnancy="obitograv", puerperium="obitopuerp", sex="sexo") -> Column:
    """Superset of F1 and F2 over *raw* (unrecoded, unfilled) codes.

    It only uses raw columns, so it reaches the Parquet scan as pushed filters:
    the classification then runs on female pregnancy-related rows only.
    (O935/O937 recode to O95, which stays inside O000..O999; filling nulls with
    9 never creates a 1 or 2.)
    """
    c, g, p = _c(cause), _c(pregnancy), _c(puerperium)
    cause_superset = (
        _between(c, "O000", "O999")
        | c.isin("A34", "D392", "E230", "M830")
        | _between(c, "B200", "B249")
        | _between(c, "F530", "F539")
    )
    return is_female(sex) & (cause_superset | (g == "1") | p.isin("1", "2"))


def is_external_prefix(chapter: Column | str = "capitulo_cid10") -> Column:
    """State-mart rule: chapter text starting with XX (so XXI and XXII too); null -> False."""
    return F.coalesce(_c(chapter).rlike("^XX"), F.lit(False))


def is_external_chapter(chapter: Column | str = "capitulo_cid10") -> Column:
    """Dashboard rule: exactly chapter XX (null -> null, i.e. dropped by a filter on its negation)."""
    return _c(chapter) == S.EXTERNAL_CHAPTER


def period_slug(period: Column | str = "periodo_do_obito") -> Column:
    """Column slug of a not-considered period (lower case, accents and punctuation removed)."""
    p = _c(period)
    expr = F.lit(None).cast("string")
    for label, slug in reversed(S.NOT_CONSIDERED_PERIODS):
        expr = F.when(p == label, F.lit(slug)).otherwise(expr)
    return expr


def uf_pivot_key(period: Column | str = "periodo_do_obito", chapter: Column | str = "capitulo_cid10") -> Column:
    """Name of the state-mart column a not-considered death is counted in."""
    return F.concat(
        F.lit("obitos_descons_"), period_slug(period),
        F.when(is_external_prefix(chapter), F.lit("_ext")).otherwise(F.lit("_exceto_ext")),
    )


def long_date_pt(d: Column | str) -> Column:
    """'05 de março de 2024' from a date or timestamp column."""
    d = _c(d)
    months = F.array(*[F.lit(m) for m in S.MONTHS_PT])
    return F.concat(
        F.date_format(d, "dd"), F.lit(" de "), F.element_at(months, F.month(d)),
        F.lit(" de "), F.date_format(d, "yyyy"),
    )


def format_number_br(x: Column | str, decimals: int = 0) -> Column:
    """Thousands '.', decimals ',' (Brazilian display format)."""
    return F.translate(F.format_number(_c(x), decimals), ",.", ".,")


def percent_tenths(n: Column, d: Column) -> Column:
    """100*n/d rounded half-up to one decimal, from integers only (same in any engine)."""
    return F.when(d > 0, F.call_function("div", n * 2000 + d, d * 2) / 10.0)
