import datetime as dt
import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators import panels
from opsboard.plans.service_board import ServiceBoard
from opsboard.sources import export, kpi_facts, services as source
from opsboard.sources.dictionaries import countries, months, status_domain, with_label

HEADER = "NOMBRE,NODO,SOA,ID CUENTA,CUENTA,STATUS,# SERVICIOS,PERIODO GESTION,COORDINADOR"
LINES = [
    " Ana ,GT,gt,007,Seguros,Concluido,5,2025-01-31 10:00:00,012",
    ',GT,gt,008,"Uno, ""dos""",En proceso,2,2025-02-01,12',
    "Luis,GT,gt,009,PRUEBA interna,Concluido,100,2025-02-01,13",
    ",MX,mx,010,,Cancelado posterior,3,,",
]


@pytest.fixture
def extract(tmp_path):
    path = tmp_path / "extract.csv"
    path.write_text("\n".join([HEADER, *LINES]) + "\n", encoding="utf-8")
    return str(path)


def test_csv_extract_is_read_by_header_and_cleaned(spark, extract, rows):
    loaded = source.load_services(spark, extract, "apertura", fmt="csv").orderBy("idcuenta")
    assert loaded.columns == schema.SERVICES.names
    assert [f.dataType for f in loaded.schema] == [f.dataType for f in schema.SERVICES]
    assert rows(loaded, "idcuenta", "cuenta", "servicios", "mes", "agente", "coord_code") == [
        ("007", "Seguros", 5, dt.date(2025, 1, 1), "Ana", "012"),
        ("008", 'Uno, "dos"', 2, dt.date(2025, 2, 1), "12", "12"),
        ("010", None, 3, None, "(Sin asignar)", "—"),
    ]


def test_two_perspectives_are_told_apart_by_file(spark, extract, rows):
    both = source.load_perspectives(spark, {"apertura": extract, "gestion": extract}, fmt="csv")
    assert rows(panels.clean_summary(both).orderBy("perspectiva"), "perspectiva", "filas", "servicios", "sin_cuenta") == [
        ("apertura", 3, 10, 1),
        ("gestion", 3, 10, 1),
    ]


def test_board_from_files(spark, extract, rows):
    board = ServiceBoard.load(spark, {"apertura": extract, "gestion": extract}, fmt="csv")
    assert rows(board.panels()["detalle"], "perspectiva", "cuenta", "servicios") == [
        ("apertura", "Seguros", 5), ("apertura", 'Uno, "dos"', 2), ("gestion", "Seguros", 5), ("gestion", 'Uno, "dos"', 2)
    ]
    shares = {name: rows(board.breakdown(name, 1).filter("perspectiva = 'gestion'"), name, "pct") for name in schema.DIMENSIONS}
    assert shares == {
        "nodo": [("GT", 70.0)], "soa": [("gt", 70.0)], "cuenta": [("Seguros", 50.0)], "agente": [("Ana", 50.0)]
    }
    with pytest.raises(ValueError, match="no dimension"):
        board.breakdown("estado")


def test_bad_dates_raise_or_are_counted(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("\n".join([HEADER, LINES[0], LINES[1].replace("2025-02-01", "soon")]), encoding="utf-8")
    raw = source.read_extract(spark, str(path), "csv")
    assert source.rejected_dates(raw).count() == 1
    assert source.load_services(spark, str(path), "apertura", "csv", bad_dates="null").filter("mes IS NULL").count() == 1
    with pytest.raises(Exception, match="not a date: soon"):
        source.load_services(spark, str(path), "apertura", "csv").select("mes").collect()


def test_date_format_option(spark, tmp_path):
    path = tmp_path / "dmy.csv"
    path.write_text("\n".join([HEADER, LINES[0].replace("2025-01-31 10:00:00", "31/01/2025")]), encoding="utf-8")
    loaded = source.load_services(spark, str(path), "apertura", "csv", date_format="dd/MM/yyyy")
    assert loaded.first()["mes"] == dt.date(2025, 1, 1)


def test_services_table_is_laid_out_by_month(spark, extract, tmp_path):
    target = str(tmp_path / "services")
    export.write_services(source.load_services(spark, extract, "apertura", fmt="csv"), target)
    back = spark.read.parquet(target)
    assert dict(back.dtypes)["mes"] == "date"
    january = back.filter(F.col("mes") == F.lit(dt.date(2025, 1, 1)))
    assert january.count() == 1
    assert "PartitionFilters: [isnotnull(mes" in january._jdf.queryExecution().executedPlan().toString()


def test_detail_csv_keeps_order_and_quotes(spark, services, tmp_path):
    detail = panels.detail_table(
        services({"servicios": 2, "cuenta": 'Uno, "dos"'}, {"servicios": 9, "cuenta": "Ñandú"}, {"cuenta": None})
    )
    target = str(tmp_path / "out")
    export.write_detail_csv(detail.drop("perspectiva"), target)
    lines = []
    for part in sorted(glob.glob(target + "/part-*.csv")):
        with open(part, encoding="utf-8") as handle:
            header, *body = handle.read().splitlines() or [None]
            assert header in (None, "NODO,SOA,CUENTA,ESTATUS,SERVICIOS")
            lines += body
    assert lines == ["N1,P1,Ñandú,Concluido,9", 'N1,P1,"Uno, ""dos""",Concluido,2']


def test_dictionaries(spark, rows):
    assert rows(status_domain(spark), "ord", "estatus") == list(enumerate(schema.STATUSES))
    assert rows(months(spark), "mes_num", "label")[11] == (12, "Dic")
    assert countries(spark).count() == 22 and schema.YEARS == (2019, 2020, 2021, 2022, 2023, 2024, 2025, 2026)
    df = spark.createDataFrame([("gt",), ("zz",), (None,)], "pais string")
    got = {r["pais"]: r["etiqueta"] for r in with_label(df, countries(spark), "pais").collect()}
    assert got == {"gt": "Guatemala", "zz": "zz", None: None}


def test_dictionaries_have_a_known_size(spark):
    plan = with_label(spark.range(5).selectExpr("cast(id as string) pais"), countries(spark), "pais")
    assert "BroadcastHashJoin" in plan._jdf.queryExecution().executedPlan().toString()


def test_kpi_facts_conform_to_the_contract(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.sql("SELECT 'K' AS kpi_id, date'2025-01-01' AS mes, 1.5D AS valor, 'x' AS extra").write.parquet(path)
    facts = kpi_facts.read_kpi_actuals(spark, path)
    assert facts.columns == schema.KPI_ACTUALS.names
    assert facts.first().asDict() == {
        "kpi_id": "K", "mes": dt.date(2025, 1, 1), "pais": None, "escenario": None,
        "valor": Decimal("1.5000"), "ci_lower": None, "ci_upper": None,
    }
    with pytest.raises(ValueError, match="mes"):
        kpi_facts.conform(spark.sql("SELECT 'K' AS kpi_id"), schema.KPI_ACTUALS)
    spark.read.parquet(path).createOrReplaceTempView("facts_view")
    assert kpi_facts.read_kpi_actuals(spark, "facts_view", fmt=None).count() == 1
