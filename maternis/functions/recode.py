"""Row-wise recodes of raw certificate codes (pure Column builders).

All of them are built-in expressions, so they stay inside whole-stage codegen.
Era-dependent rules take the era or the file year as a Column: one plan covers
every year, no per-chunk loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def label_map(labels: dict[str, str]) -> Column:
    """A constant map literal (folded at plan time, one lookup per row)."""
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])


def code_map(c: Column | str, labels: dict[str, str], unknown: tuple[str, ...] = ("9",),
             unknown_label: str = S.IGNORED) -> Column:
    """code -> label; null or any of ``unknown`` -> ``unknown_label``; other -> null.

    A map lookup rather than a CASE chain: the generated code stays small
    enough for the JIT when a dozen recodes share one whole-stage method.
    """
    c = _c(c)
    return F.when(c.isNull() | c.isin(*unknown), F.lit(unknown_label)).otherwise(
        F.element_at(label_map(labels), c))


def recode_cause(c: Column | str = "causabas") -> Column:
    """O935 and O937 are reported as O95; null stays null."""
    c = _c(c)
    return F.when(c.isin("O935", "O937"), F.lit("O95")).otherwise(c)


def fill_pregnancy_code(c: Column | str = "obitograv") -> Column:
    """Null 'died during pregnancy' code becomes 9 (ignored)."""
    return F.coalesce(_c(c), F.lit("9"))


def fill_puerperium_code(c: Column | str, era: Column) -> Column:
    """Null becomes 9; the history files also fold 0, 4 and 8 into 9."""
    c = _c(c)
    fold = c.isNull() | ((era == S.HISTORY) & c.isin("0", "4", "8"))
    return F.when(fold, F.lit("9")).otherwise(c)


def year_from_date(c: Column | str = "dtobito") -> Column:
    """Year = last four characters of the packed ddmmyyyy date (7 or 8 digits)."""
    c = _c(c)
    return F.substring(c, -4, 4).try_cast("int")


def decode_age(c: Column | str = "idade") -> Column:
    """Registry age code -> years.

    999 or null -> 99; 400..499 -> the last two digits (years); any other
    number (hours, days, months, 100+ years) -> 0; non-numeric text -> null.
    """
    c = _c(c)
    n = c.try_cast("double")
    return (
        F.when(c.isNull() | (c == "999"), F.lit(99))
        .when(n.isNull(), F.lit(None).cast("int"))
        .when((n >= 400) & (n <= 499), F.substring(c, 2, 2).try_cast("int"))
        .otherwise(F.lit(0))
    )


def recode_race(c: Column | str = "racacor") -> Column:
    return code_map(c, S.RACE_LABELS)


def recode_marital(c: Column | str, era: Column) -> Column:
    """Marital status; the history and preliminary files use different labels."""
    return F.when(era == S.HISTORY, code_map(c, S.MARITAL_LABELS_HISTORY)).otherwise(
        code_map(c, S.MARITAL_LABELS_PRELIMINARY))


def harmonise_marital(c: Column | str = "est_civil") -> Column:
    """Optional: map the preliminary (masculine) labels onto the history ones."""
    c = _c(c)
    expr = c
    for code, label in S.MARITAL_LABELS_PRELIMINARY.items():
        expr = F.when(c == label, S.MARITAL_LABELS_HISTORY[code]).otherwise(expr)
    return expr


def recode_place(c: Column | str = "lococor") -> Column:
    return code_map(c, S.PLACE_LABELS, unknown=("9", "6"))


def recode_assistance(c: Column | str = "assistmed") -> Column:
    return code_map(c, S.ASSIST_LABELS)


def recode_necropsy(c: Column | str = "necropsia") -> Column:
    return code_map(c, S.NECROPSY_LABELS)


def recode_schooling(c: Column | str, file_year: Column) -> Column:
    """Schooling (2010 form). Files of the chunks that start before 2011,
    i.e. every year up to 2014, carry no usable value."""
    return F.when(file_year <= 2014, F.lit(S.IGNORED)).otherwise(code_map(c, S.SCHOOLING_LABELS))


def recode_committee(c: Column | str, file_year: Column) -> Column:
    """Investigated by a maternal-mortality committee (fonteinv = 1).
    Years up to 2005 carry no information."""
    c = _c(c)
    return (
        F.when(file_year <= 2005, F.lit(S.NO_INFO))
        .when(c == "1", F.lit(S.YES))
        .when(c.isNull() | (c == "9"), F.lit(S.NO_INFO))
        .otherwise(F.lit(S.NO))
    )


def fertile_age(age: Column | str = "idade") -> Column:
    """Sim for 10..49 years, Não otherwise (unknown age 99 -> Não), null stays null."""
    a = _c(age)
    return F.when(a.isNull(), F.lit(None).cast("string")).when(
        (a >= 10) & (a <= 49), F.lit(S.YES)).otherwise(F.lit(S.NO))
