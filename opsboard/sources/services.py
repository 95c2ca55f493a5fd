"""Service extracts: reading, header normalisation, cleaning."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsboard import schema
from opsboard.functions.calendar import month_start
from opsboard.functions.text import coordinator_code, coordinator_name, is_test_account, strip

# ---- reading ----------------------------------------------------------------------------


def listing(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The files at ``path`` (``ruta``, to open them), with what tells them apart later: ``archivo``, ``bytes``
    and ``modificado``. Spark lists them; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.col("path").alias("ruta"),
        F.col("_metadata.file_path").alias("archivo"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_modification_time").alias("modificado"),
    )


def csv_signatures(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Per CSV file its header line (``cabecera``) and whether a quoted value goes over several lines (``partido``).

    One pass over the text; a line and a sum per file and task are all that leaves it.
    """
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        "value", "_metadata.file_path", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
    )
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    # a set of the two answers, not bool_or: with it the aggregate goes by hash, else all lines would be sorted by file
    found = lines.groupBy(F.col("file_path").alias("archivo")).agg(
        F.min_by("value", "at").alias("cabecera"), F.array_contains(F.collect_set(quotes % 2 == 1), True).alias("partido")
    )
    return found.join(listing(spark, path).select("archivo", "ruta"), "archivo")


def _names(header: str) -> list[str]:
    """Column names of a header line; a repeated one counts once, the others get a name nobody asks for."""
    names: list[str] = []
    for place, name in enumerate(next(csv.reader([header.removeprefix("\ufeff")]))):
        name = name.strip()
        names.append(name if name and name not in names else f"_{place}")
    return names


def _require(names: Sequence[str], where: str) -> None:
    missing = [h for h in schema.RAW_SERVICES.names if h not in names]
    if missing:
        raise ValueError(f"{where} lacks the columns {', '.join(missing)}")


def _read_csv(spark: SparkSession, path: str | Sequence[str], archivo: str | None) -> DataFrame:
    """CSV files whose headers need not be alike: one read per kind of header, put together by name.

    Only files that have line breaks within quotes are read as a whole; all others can be split.
    """
    groups: dict[tuple[str, bool], list[str]] = {}
    for row in csv_signatures(spark, path).collect():  # one row per file
        groups.setdefault((row["cabecera"], row["partido"]), []).append(row["ruta"])
    parts = []
    for (header, broken), files in sorted(groups.items()):
        names = _names(header)
        _require(names, files[0])
        reader = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names]))
        rows = reader.option("header", True).option("escape", '"').option("multiLine", broken).csv(files)
        parts.append(_with_file(rows, archivo))
    if not parts:
        struct = T.StructType([*schema.RAW_SERVICES, *([T.StructField(archivo, T.StringType())] if archivo else [])])
        return spark.createDataFrame([], struct)
    raw = parts[0]
    for other in parts[1:]:
        raw = raw.unionByName(other)
    return raw


def _with_file(rows: DataFrame, archivo: str | None) -> DataFrame:
    columns = [F.col(f"`{name}`") for name in schema.RAW_SERVICES.names]
    if "perspectiva" in rows.columns:
        columns.append(F.col("perspectiva"))
    if archivo:
        columns.append(F.col("_metadata.file_path").alias(archivo))
    return rows.select(*columns)


def read_extract(
    spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", archivo: str | None = None
) -> DataFrame:
    """One raw extract, of one file or many; with ``archivo``, the file of each row in a column of that name.

    CSV columns are found by header name, file by file, and stay text, so codes keep their zeros. A column that is
    missing is told by name.
    """
    if fmt == "csv":
        return _read_csv(spark, path, archivo)
    rows = spark.read.format(fmt).load(path)
    _require(rows.columns, path if isinstance(path, str) else path[0])
    return _with_file(rows, archivo)


# ---- types ------------------------------------------------------------------------------


def _moment(raw: Column, dtype: T.DataType, date_format: str | None, bad_dates: str) -> Column:
    """Zone-free timestamp. Columns that are already dates are passed on as they are, which keeps
    filters on them pushable to the file scan."""
    if not isinstance(dtype, T.StringType):
        return raw.cast("timestamp_ntz")
    text = F.nullif(strip(raw), F.lit(""))
    if date_format is None:
        parsed = text.try_cast("timestamp_ntz")
    else:
        parsed = F.try_to_timestamp(text, F.lit(date_format)).cast("timestamp_ntz")
    if bad_dates == "null":
        return parsed
    complaint = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("timestamp_ntz")
    return F.when(text.isNotNull() & parsed.isNull(), complaint).otherwise(parsed)


def _text(raw: Column, dtype: T.DataType) -> Column:
    """A code as text. Numbers with a gap in their column arrive as fractions: a whole one is written whole."""
    if not isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return raw.cast("string")
    whole = raw.try_cast("decimal(38,0)")
    return F.when(whole == raw, whole.cast("string")).otherwise(raw.cast("string"))


def canonical(raw: DataFrame, date_format: str | None = None, bad_dates: str = "raise") -> DataFrame:
    """Rename the raw headers and settle the types; a ``perspectiva`` column is kept if present."""
    columns = []
    for header, name in schema.SERVICE_HEADERS.items():
        source, dtype = F.col(f"`{header}`"), raw.schema[header].dataType
        if name == "periodo":
            source = _moment(source, dtype, date_format, bad_dates)
        elif name == "servicios":
            source = source.cast("long")
        else:
            source = _text(source, dtype)
        columns.append(source.alias(name))
    if "perspectiva" in raw.columns:
        columns.insert(0, F.col("perspectiva"))
    return raw.select(*columns)


def rejected_dates(raw: DataFrame, date_format: str | None = None) -> DataFrame:
    """Rows whose date text cannot be read, for a reject count before a strict load."""
    header = "PERIODO GESTION"
    parsed = _moment(F.col(f"`{header}`"), raw.schema[header].dataType, date_format, "null")
    return raw.filter(_filled(header) & parsed.isNull())


def _filled(header: str) -> Column:
    return F.nullif(strip(F.col(f"`{header}`").cast("string")), F.lit("")).isNotNull()


# ---- cleaning ---------------------------------------------------------------------------


def derived(services: DataFrame) -> DataFrame:
    """Month, coordinator and coordinator code."""
    # stripped in a step of its own: the rules below look at each text several times
    nombre, code = F.col("_nombre"), F.col("_code")
    return (
        services.withColumns({"_nombre": strip(F.col("nombre")), "_code": strip(F.col("coordinador"))})
        .withColumns(
            {
                "mes": month_start(F.col("periodo")),
                "agente": coordinator_name(nombre, code),
                "coord_code": coordinator_code(code),
            }
        )
        .drop("_nombre", "_code")
    )


def clean(services: DataFrame, test_accounts: str = schema.TEST_ACCOUNTS) -> DataFrame:
    """Leave out test accounts; derive month, coordinator and coordinator code."""
    return derived(services.filter(~is_test_account(F.col("cuenta"), test_accounts)))


GOOD, REJECTED = "limpio", "rechazo"


def sorted_out(
    raw: DataFrame, seen: Observation, date_format: str | None = None, test_accounts: str = schema.TEST_ACCOUNTS
) -> DataFrame:
    """Clean services and rejects in one table, told apart by ``destino``, from one pass over ``raw``.

    Test accounts are left out whatever else is wrong with their row. A row is rejected for a date or a
    number of services that is there but cannot be read; ``motivo`` says which and ``crudo`` keeps the raw
    row as JSON. ``seen`` counts the pass: filas = pruebas + fechas + cantidades + cargadas.

    ``raw`` may have further columns (its file, its perspective); they are kept.
    """
    header = {name: h for h, name in schema.SERVICE_HEADERS.items()}
    amount, moment = F.col(f"`{header['servicios']}`"), header["periodo"]
    parsed = {
        "servicios": amount.try_cast("long"),
        "periodo": _moment(F.col(f"`{moment}`"), raw.schema[moment].dataType, date_format, "null"),
    }
    columns = [
        parsed.get(name, _text(F.col(f"`{h}`"), raw.schema[h].dataType)).alias(name) for h, name in schema.SERVICE_HEADERS.items()
    ]
    others = [F.col(f"`{c}`") for c in raw.columns if c not in schema.SERVICE_HEADERS]
    test = is_test_account(_text(F.col(f"`{header['cuenta']}`"), raw.schema[header["cuenta"]].dataType), test_accounts)
    reason = (
        F.when(test, "prueba")
        .when(parsed["periodo"].isNull() & _filled(moment), "fecha")
        .when(parsed["servicios"].isNull() & _filled(header["servicios"]), "cantidad")
    )
    as_read = F.to_json(F.struct(*[F.col(f"`{h}`") for h in schema.SERVICE_HEADERS]), {"ignoreNullFields": "false"})
    typed = raw.select(*others, *columns, reason.alias("motivo"), F.when(reason.isNotNull(), as_read).alias("crudo"))
    motivo = F.col("motivo")
    counted = typed.observe(
        seen,
        F.count(F.lit(1)).alias("filas"),
        F.count_if(motivo == "prueba").alias("pruebas"),
        F.count_if(motivo == "fecha").alias("fechas"),
        F.count_if(motivo == "cantidad").alias("cantidades"),
        F.count_if(motivo.isNull()).alias("cargadas"),
    )
    rows = counted.filter(motivo.isNull() | (motivo != "prueba"))
    return derived(rows).withColumn("destino", F.when(motivo.isNull(), GOOD).otherwise(REJECTED))


def load_services(
    spark: SparkSession,
    path: str | Sequence[str],
    perspectiva: str,
    fmt: str = "parquet",
    date_format: str | None = None,
    bad_dates: str = "raise",
    test_accounts: str = schema.TEST_ACCOUNTS,
) -> DataFrame:
    """One extract as clean services. What its date means is told by the file, not by the header."""
    raw = read_extract(spark, path, fmt).withColumn("perspectiva", F.lit(perspectiva))
    services = clean(canonical(raw, date_format, bad_dates), test_accounts)
    return services.select(*schema.SERVICES.names)


def load_perspectives(spark: SparkSession, paths: Mapping[str, str], **options) -> DataFrame:
    """All extracts in one table, told apart by ``perspectiva``."""
    loaded = [load_services(spark, path, name, **options) for name, path in paths.items()]
    services = loaded[0]
    for other in loaded[1:]:
        services = services.unionByName(other)
    return services
