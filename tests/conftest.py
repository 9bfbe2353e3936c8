import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from maternis.session import get_session
    s = get_session("local[*]", 8)
    yield s
    s.stop()


RAW_DEFAULTS = {
    "sexo": "2", "causabas": "O000", "obitograv": "1", "obitopuerp": "3", "dtobito": "01012010",
    "idade": "430", "racacor": "1", "estciv": "1", "esc2010": "1", "lococor": "1",
    "assistmed": "1", "necropsia": "1", "fonteinv": "1", "codmunres": "1",
}


def raw_rows(spark, rows):
    """Raw certificates from partial dicts (missing fields take the defaults;
    ``ano_arquivo`` defaults to the year of ``dtobito``)."""
    from maternis.schema import RAW_COLUMNS
    out = []
    for r in rows:
        full = {**RAW_DEFAULTS, **r}
        year = full.pop("ano_arquivo", None)
        if year is None:
            year = int(full["dtobito"][-4:]) if full["dtobito"] else None
        out.append(tuple(full[c] for c in RAW_COLUMNS) + (year,))
    schema = ", ".join(f"{c} string" for c in RAW_COLUMNS) + ", ano_arquivo int"
    return spark.createDataFrame(out, schema)


def municipalities(spark):
    return spark.createDataFrame(
        [("1", "1", "Águas", "N01", "Norte"), ("2", "2", "Belém", "N02", "Sul"),
         ("3", "3", "Zeta", "N03", None)],
        "codmunres string, res_codigo_adotado string, municipio string, uf string, regiao string")


def icd(spark, codes):
    from maternis.operators.dims import icd_dimension
    from maternis.sources.files import chapters_frame
    df = spark.createDataFrame([(c,) for c in codes], "causabas string")
    return icd_dimension(df, chapters_frame(spark))
