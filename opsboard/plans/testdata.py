"""The boards' inputs as views over the star-schema test tables.

Services are order lines: node = region, country = nation, account = customer, coordinator =
supplier. KPI facts are order amounts per month and nation. The test tables carry no padded names,
test accounts or missing codes, so the view derives those from the keys, by the same rule in the
SQL twins.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema
from opsboard.functions.calendar import month_start, months_covered
from opsboard.operators.metrics import scenario_tag
from opsboard.sources.dictionaries import small_table
from opsboard.sources.services import canonical, clean

CUTOFF = "2000-12-01"  # last actual month; later ones are forecast


# Declared column types: reading needs no job to look into a footer first.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, "
    "o_orderpriority string",
    "lineitem": "l_orderkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
    "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, event_type string, value double",
    "documents": "doc_id long, lang string",
    "labels": "doc_id long, quality int",
    "conversations": "conv_id long, turn long, role string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


# ---- services -------------------------------------------------------------------------


RAW_COLUMNS = [
    "r_name AS NODO",
    "n_name AS SOA",
    "CAST(c_custkey AS STRING) AS `ID CUENTA`",
    """CASE WHEN c_custkey % 50 = 0 THEN 'Prueba ' || c_name WHEN c_custkey % 50 = 1 THEN 'IKATECH ' || c_name
       WHEN c_custkey % 77 = 5 THEN NULL ELSE c_name END AS CUENTA""",
    """CASE WHEN l_returnflag = 'A' THEN 'Cancelado al momento' WHEN l_returnflag = 'R' THEN 'Cancelado posterior'
       WHEN l_linestatus = 'F' THEN 'Concluido' ELSE 'En proceso' END AS STATUS""",
    "CAST(l_quantity AS BIGINT) AS `# SERVICIOS`",
    """CASE WHEN s_suppkey % 20 = 0 THEN NULL WHEN s_suppkey % 20 = 1 THEN ''
       ELSE ' C' || CAST(s_suppkey AS STRING) END AS COORDINADOR""",
    """CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '   '
       ELSE '  ' || s_name || ' ' END AS NOMBRE""",
]


def _dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with account, country, node and coordinator.

    Dimensions are joined to the orders first; which of them is broadcast is left to their measured
    size. Lines and orders both grow with the data, so that join is a sort-merge join on the order
    key, whatever the compressed file sizes suggest: it spills, and skewed parts get split.
    """
    orders = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    )


def raw_extract(spark: SparkSession, sf_dir: str, perspectiva: str) -> DataFrame:
    """One perspective in the raw layout; date filters on it reach the file scan."""
    moment = "o_orderdate" if perspectiva == "apertura" else "l_shipdate"
    return _dated_lines(spark, sf_dir).selectExpr(
        f"'{perspectiva}' AS perspectiva", f"{moment} AS `PERIODO GESTION`", *RAW_COLUMNS
    )


def raw_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both perspectives from one join: each line is unfolded into its opening and its handling."""
    dated = """inline(array(struct('apertura' AS perspectiva, o_orderdate AS `PERIODO GESTION`),
                            struct('gestion' AS perspectiva, l_shipdate AS `PERIODO GESTION`)))"""
    return _dated_lines(spark, sf_dir).selectExpr(dated, *RAW_COLUMNS)


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(canonical(raw_extracts(spark, sf_dir)))


def services_by_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a union of two separately loaded extracts."""
    opened, handled = (clean(canonical(raw_extract(spark, sf_dir, p))) for p in schema.PERSPECTIVES)
    return opened.unionByName(handled)


# ---- KPI facts ------------------------------------------------------------------------


def amount() -> Column:
    """Exact line amount. Decimal before multiplying, so no product is rounded."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    return price * (1 - F.col("l_discount").cast("decimal(4,2)"))


def customer_lines(spark: SparkSession, sf_dir: str, months: tuple[date, date] | None = None) -> DataFrame:
    """Lines with their order and its customer, of all months or of some (both included; a range of days
    that the scan of the orders understands). Customers join the orders, not the many more lines."""
    orders = table(spark, sf_dir, "orders")
    if months is not None:
        first, end = (F.lit(day.isoformat()).cast("timestamp_ntz") for day in months_covered(*months))
        orders = orders.filter((F.col("o_orderdate") >= first) & (F.col("o_orderdate") < end))
    orders = orders.join(
        table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return table(spark, sf_dir, "lineitem").join(
        orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order only, where the customer key is enough."""
    return table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")
    )


def kpi_actuals(spark: SparkSession, sf_dir: str, months: tuple[date, date] | None = None) -> DataFrame:
    """Monthly revenue, claims and EBITDA per nation key, with bounds outside months 3, 6, 9, 12."""
    zero = F.lit(0).cast("decimal(38,4)")
    monthly = (
        customer_lines(spark, sf_dir, months)
        .groupBy(month_start(F.col("o_orderdate")).alias("mes"), F.col("c_nationkey").cast("string").alias("pais"))
        .agg(
            F.sum(amount()).alias("ingresos"),
            F.coalesce(F.sum(F.when(F.col("l_returnflag") == "R", amount())), zero).alias("siniestralidad"),
        )
    )
    amounts = {
        "INGRESOS": F.col("ingresos"),
        "SINIESTRALIDAD": F.col("siniestralidad"),
        "EBITDA": F.col("ingresos") - F.col("siniestralidad"),
    }
    kpis = F.array(
        *[
            F.struct(F.lit(kpi).alias("kpi_id"), valor.cast("decimal(38,4)").alias("valor"))
            for kpi, valor in amounts.items()
        ]
    )
    bounded = F.month("mes") % 3 != 0
    valor = F.col("valor").cast("double")
    return monthly.select("mes", "pais", F.inline(kpis)).select(
        "kpi_id",
        "mes",
        "pais",
        scenario_tag(F.col("mes"), F.lit(CUTOFF).cast("date")).alias("escenario"),
        "valor",
        F.when(bounded, valor * 0.9).alias("ci_lower"),
        F.when(bounded, valor * 1.1).alias("ci_upper"),
    )


# Targets of the test boards. FLUJO has no facts, so its card is pending.
TARGET_ROWS = [
    ("INGRESOS", "Ventas del mes", "currency", "USD", 22_000_000.0, ">=", "dic 2000", None, None),
    ("EBITDA", "Ventas tras reclamos", "currency", "USD", 15_500_000.0, ">=", "dic 2000", None, None),
    ("SINIESTRALIDAD", "Reclamos del mes", "currency", "USD", None, "<=", "abierto", "sin meta", None),
    ("FLUJO", "Caja del mes", "currency", "USD", None, ">=", "abierto", None, "sin dato"),
]

# Targets of a period: the first two overlap, open ends on either side, one that never holds.
PERIOD_TARGET_ROWS = [
    ("INGRESOS", None, date(1996, 12, 1), 18_000_000.0),
    ("INGRESOS", date(1996, 7, 1), date(1999, 6, 30), 21_000_000.0),
    ("INGRESOS", date(1999, 1, 1), None, 24_000_000.0),
    ("SINIESTRALIDAD", date(1997, 1, 15), date(1998, 12, 1), 7_000_000.0),
    ("EBITDA", date(2001, 1, 1), date(1995, 1, 1), 1.0),
]
PERIOD_TARGETS = T.StructType(
    [
        T.StructField("kpi_id", T.StringType()),
        T.StructField("desde", T.DateType()),
        T.StructField("hasta", T.DateType()),
        T.StructField("target", T.DoubleType()),
    ]
)


def kpi_targets(spark: SparkSession) -> DataFrame:
    return small_table(spark, TARGET_ROWS, schema.KPI_TARGETS)


def segment_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly revenue by market segment."""
    return (
        customer_lines(spark, sf_dir)
        .groupBy(F.col("c_mktsegment").alias("segmento"), month_start(F.col("o_orderdate")).alias("mes"))
        .agg(F.sum(amount()).alias("valor"))
    )
