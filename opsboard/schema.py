"""Column contracts, fixed domains and dictionaries."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- services -------------------------------------------------------------------------

# Raw header of a services extract -> canonical column.
SERVICE_HEADERS = {
    "NODO": "nodo",
    "SOA": "soa",
    "ID CUENTA": "idcuenta",
    "CUENTA": "cuenta",
    "STATUS": "estatus",
    "# SERVICIOS": "servicios",
    "PERIODO GESTION": "periodo",
    "COORDINADOR": "coordinador",
    "NOMBRE": "nombre",
}

# What an extract must have; a text file has nothing but text.
RAW_SERVICES = T.StructType([T.StructField(header, T.StringType()) for header in SERVICE_HEADERS])

SERVICES = T.StructType(
    [
        T.StructField("perspectiva", T.StringType(), False),
        T.StructField("nodo", T.StringType()),
        T.StructField("soa", T.StringType()),
        T.StructField("idcuenta", T.StringType()),
        T.StructField("cuenta", T.StringType()),
        T.StructField("estatus", T.StringType()),
        T.StructField("servicios", T.LongType()),
        T.StructField("periodo", T.TimestampNTZType()),
        T.StructField("mes", T.DateType()),
        T.StructField("coordinador", T.StringType()),
        T.StructField("nombre", T.StringType()),
        T.StructField("agente", T.StringType(), False),
        T.StructField("coord_code", T.StringType(), False),
    ]
)

PERSPECTIVES = ("apertura", "gestion")

# The four known statuses in display order.
CONCLUDED = "Concluido"
IN_PROGRESS = "En proceso"
CANCELLED_AT_ONCE = "Cancelado al momento"
CANCELLED_LATER = "Cancelado posterior"
STATUSES = (CONCLUDED, IN_PROGRESS, CANCELLED_AT_ONCE, CANCELLED_LATER)

# Dimension -> heading.
DIMENSIONS = {
    "nodo": "Nodo",
    "soa": "País",
    "cuenta": "Cuenta",
    "agente": "Coordinador de cabina",
}

# Fallbacks and the pattern of accounts that are not real customers.
UNASSIGNED = "(Sin asignar)"
NO_CODE = "—"
TEST_ACCOUNTS = "(?iu)prueba|ikatech|no apertur"

# ---- KPI facts ------------------------------------------------------------------------

KPI_ACTUALS = T.StructType(
    [
        T.StructField("kpi_id", T.StringType(), False),
        T.StructField("mes", T.DateType(), False),
        T.StructField("pais", T.StringType()),
        T.StructField("escenario", T.StringType()),
        # money stays decimal: its sums do not depend on the order the shuffle delivers rows in
        T.StructField("valor", T.DecimalType(38, 4)),
        T.StructField("ci_lower", T.DoubleType()),
        T.StructField("ci_upper", T.DoubleType()),
    ]
)

KPI_TARGETS = T.StructType(
    [
        T.StructField("kpi_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("value_format", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("target", T.DoubleType()),
        T.StructField("direction", T.StringType()),
        T.StructField("period_label", T.StringType()),
        T.StructField("formatted", T.StringType()),
        T.StructField("pending_label", T.StringType()),
    ]
)

# A card as it is stored: what one card has and another lacks is null. ``status`` is stored, never
# computed from value and target.
KPI_CARD = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("value_unit", T.StringType()),
        T.StructField("value_format", T.StringType()),
        T.StructField("value_period_label", T.StringType()),
        T.StructField("display_value", T.StringType()),
        T.StructField("pending_label", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("okr_label", T.StringType()),
        T.StructField("subtitle", T.StringType()),
        T.StructField(
            "rows",
            T.ArrayType(
                T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.DoubleType())])
            ),
        ),
        T.StructField(
            "secondary_line",
            T.StructType([T.StructField("label", T.StringType()), T.StructField("value", T.StringType())]),
        ),
        T.StructField(
            "target",
            T.StructType(
                [
                    T.StructField("value", T.DoubleType()),
                    T.StructField("unit", T.StringType()),
                    T.StructField("formatted", T.StringType()),
                    T.StructField("text", T.StringType()),
                    T.StructField("period_label", T.StringType()),
                    T.StructField("growth_label", T.StringType()),
                    T.StructField("extra", T.StringType()),
                ]
            ),
        ),
    ]
)

GROUPED_SERIES = T.StructType(
    [
        T.StructField("categories", T.ArrayType(T.StringType())),
        T.StructField("name", T.StringType()),
        T.StructField("valores", T.ArrayType(T.DoubleType())),
    ]
)

REAL, FORECAST = "REAL", "FCST"

# ---- dictionaries (fixed values) --------------------------------------------------------

MONTHS = ("Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic")

YEARS = tuple(range(2019, 2027))

COUNTRIES = {
    "ar": "Argentina",
    "bo": "Bolivia",
    "br": "Brasil",
    "cl": "Chile",
    "co": "Colombia",
    "cr": "Costa Rica",
    "do": "República Dominicana",
    "ec": "Ecuador",
    "eg": "Egipto",
    "es": "España",
    "gt": "Guatemala",
    "hn": "Honduras",
    "mx": "México",
    "ni": "Nicaragua",
    "pa": "Panamá",
    "pe": "Perú",
    "pr": "Puerto Rico",
    "py": "Paraguay",
    "sv": "El Salvador",
    "us": "Estados Unidos",
    "uy": "Uruguay",
    "ve": "Venezuela",
}

# Colours of a milestone; any other is amber.
MILESTONE_COLOURS = ("green", "amber", "red")
DEFAULT_MILESTONE = "amber"
