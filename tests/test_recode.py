"""Edge rows of the recodes and derived labels (one stage at a time)."""

from conftest import raw_rows

from maternis.plans.classify import derive_stage, recode_stage


def _derive(spark, rows, cols):
    df = derive_stage(recode_stage(raw_rows(spark, rows)))
    return [tuple(r) for r in df.select(*cols).collect()]


def test_age_decode(spark):
    rows = [{"idade": v} for v in ["433", "999", None, "305", "501", "abc", "400", "499"]]
    got = _derive(spark, rows, ["idade"])
    assert [g[0] for g in got] == [33, 99, 99, 0, 0, None, 0, 99]


def test_fertile_age(spark):
    rows = [{"idade": v} for v in ["410", "449", "409", "450", "999", "abc"]]
    assert [g[0] for g in _derive(spark, rows, ["obito_em_idade_fertil"])] == ["Sim", "Sim", "Não", "Não", "Não", None]


def test_year_from_packed_date(spark):
    rows = [{"dtobito": "5052023"}, {"dtobito": "15052023"}, {"dtobito": "023"}, {"dtobito": None}]
    assert [g[0] for g in _derive(spark, rows, ["ano"])] == [2023, 2023, 23, None]


def test_cause_recode_and_type(spark):
    rows = [{"causabas": c} for c in ["O935", "O937", "O244", "O240", "O259", "B24", "O94", "O980", "O000", None]]
    got = _derive(spark, rows, ["causabas", "tipo_de_morte_materna"])
    assert got == [("O95", "Não especificada"), ("O95", "Não especificada"), ("O244", "Direta"),
                   ("O240", "Indireta"), ("O259", "Indireta"), ("B24", "Indireta"), ("O94", "Indireta"),
                   ("O980", "Indireta"), ("O000", "Direta"), (None, None)]


def test_race_place_assist_necropsy(spark):
    rows = [{"racacor": "6", "lococor": "6", "assistmed": "9", "necropsia": "2"},
            {"racacor": None, "lococor": None, "assistmed": "3", "necropsia": None},
            {"racacor": "5", "lococor": "4", "assistmed": "2", "necropsia": "1"}]
    got = _derive(spark, rows, ["racacor", "local_ocorrencia_obito", "assistencia_med", "necropsia"])
    assert got == [(None, "Ignorado", "Ignorado", "Não"), ("Ignorado", "Ignorado", None, "Ignorado"),
                   ("Indígena", "Via Pública", "Sem assistência", "Sim")]


def test_marital_labels_by_era(spark):
    rows = [{"estciv": "1", "dtobito": "01012010"}, {"estciv": "1", "dtobito": "01012023"},
            {"estciv": "4", "dtobito": "01012024"}, {"estciv": "7", "dtobito": "01012024"}]
    assert [g[0] for g in _derive(spark, rows, ["est_civil"])] == [
        "Solteira", "Solteiro", "Separado Judic./Divorciado", None]


def test_schooling_and_committee_cutoffs(spark):
    rows = [{"esc2010": "3", "fonteinv": "1", "dtobito": "01012014"},
            {"esc2010": "3", "fonteinv": "1", "dtobito": "01012015"},
            {"esc2010": None, "fonteinv": "1", "dtobito": "01012005"},
            {"esc2010": "9", "fonteinv": "1", "dtobito": "01012006"},
            {"esc2010": "0", "fonteinv": "3", "dtobito": "01012020"},
            {"esc2010": "5", "fonteinv": None, "dtobito": "01012020"}]
    got = _derive(spark, rows, ["escolaridade", "investigacao_cmm"])
    assert got == [("Ignorado", "Sim"), ("Médio", "Sim"), ("Ignorado", "Sem informação"),
                   ("Ignorado", "Sim"), ("Sem escolaridade", "Não"), ("Superior completo", "Sem informação")]


def test_schooling_follows_file_year_not_death_year(spark):
    rows = [{"esc2010": "3", "dtobito": "01012016", "ano_arquivo": 2014}]
    assert _derive(spark, rows, ["ano", "escolaridade"]) == [(2016, "Ignorado")]


def test_puerperium_fill_by_era_and_period(spark):
    cases = [("2", "8", "01012010"), ("2", "8", "01012023"), ("9", "9", "01012010"),
             ("1", "2", "01012010"), ("8", "9", "01012010"), ("1", "3", "01012010"),
             ("2", "1", "01012010"), ("9", "2", "01012010"), (None, None, "01012010"),
             ("1", "4", "01012024")]
    rows = [{"obitograv": g, "obitopuerp": p, "dtobito": d} for g, p, d in cases]
    got = [g[0] for g in _derive(spark, rows, ["periodo_do_obito"])]
    assert got == ["Não na gravidez ou no puerpério", None, "Não informado ou ignorado",
                   "Período inconsistente", None, "Durante a gravidez, parto ou aborto",
                   "Durante o puerpério, até 42 dias", "Durante o puerpério, de 43 dias a menos de 1 ano",
                   "Não informado ou ignorado", "Durante a gravidez, parto ou aborto"]


def _model_age(s):
    """The age rule written out in Python (digit/letter strings only)."""
    if s is None or s == "999":
        return 99
    try:
        n = float(s)
    except ValueError:
        return None
    if 400 <= n <= 499:
        try:
            return int(s[1:3])
        except ValueError:
            return None
    return 0


def _model_year(s):
    if s is None:
        return None
    try:
        return int(s[-4:]) if s[-4:] else None
    except ValueError:
        return None


def test_randomised_age_and_year_against_model(spark):
    import random

    from pyspark.sql import functions as F

    from maternis.functions import recode as R
    rnd = random.Random(20261203)
    alphabet = "0123456789" * 3 + "4" * 5 + "9" * 3 + "ax"
    values = [None, ""] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 5))) for _ in range(600)]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    got = df.select("s", R.decode_age("s").alias("age"), R.year_from_date("s").alias("year")).collect()
    for r in got:
        assert r.age == _model_age(r.s), r
        assert r.year == _model_year(r.s), r
