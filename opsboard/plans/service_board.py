"""The service board: load once, select, and answer all panels; plus its registered queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsboard import schema
from opsboard.operators import distinct, leaders, options, paging, panels
from opsboard.operators.filters import Selection, apply_selection
from opsboard.plans import testdata
from opsboard.plans.catalog import Query
from opsboard.sources import export, store
from opsboard.sources.services import load_perspectives
from opsboard.storage import new_path, shared_folder, shuffles_let_go, written

CUBE_KEYS = list(distinct.CUBE_KEYS)


def monthly_cube(services: DataFrame) -> DataFrame:
    """Services summed to the dictionary keys.

    Its size is months x nodes x countries x statuses, whatever the number of rows; accounts and
    coordinators are left out because with them the cube would be about as long as the extract.
    """
    return services.groupBy(*CUBE_KEYS).agg(panels.services_sum().alias("servicios"))


def board_summary(cube: DataFrame) -> DataFrame:
    """The sums behind the total, status, trend, node, mix and hierarchy panels in one pass."""
    sets = {
        "total": [],
        "estatus": ["estatus"],
        "tendencia": ["mes", "estatus"],
        "nodo": ["nodo"],
        "mezcla": ["nodo", "estatus"],
        "jerarquia": ["nodo", "soa"],
    }
    absent = F.concat(*[F.grouping(k).cast("string") for k in ("mes", "nodo", "soa", "estatus")])
    sums = cube.groupingSets(
        [["perspectiva", *keys] for keys in sets.values()], *CUBE_KEYS
    ).agg(panels.services_sum().alias("servicios"), absent.alias("ausentes"))
    pattern = {
        "".join("0" if k in keys else "1" for k in ("mes", "nodo", "soa", "estatus")): name
        for name, keys in sets.items()
    }
    names = F.create_map(*[F.lit(x) for pair in pattern.items() for x in pair])
    return sums.select(
        F.try_element_at(names, F.col("ausentes")).alias("panel"), *CUBE_KEYS, "servicios"
    )


@dataclass(frozen=True)
class Kept:
    """What a kept board knows of members the cube has no key for: accounts as bitmaps per cell, and the
    largest accounts and coordinators of each cell."""

    accounts: DataFrame
    top_accounts: leaders.Summary
    top_agents: leaders.Summary

    def where(self, chosen: Callable[[DataFrame], DataFrame]) -> Kept:
        return Kept(chosen(self.accounts), self.top_accounts.where(chosen), self.top_agents.where(chosen))


class ServiceBoard:
    """Clean services and the panels over the reader's selection.

    The dictionary panels read the cube, the account, coordinator and detail panels the services; those of a
    kept board count and rank accounts from what was kept.
    """

    def __init__(
        self,
        services: DataFrame,
        cube: DataFrame | None = None,
        members: DataFrame | None = None,
        months: DataFrame | None = None,
        agents: DataFrame | None = None,
        kept: Kept | None = None,
    ):
        self.services = services
        self.cube = monthly_cube(services) if cube is None else cube
        self.members = options.hierarchy_members(services) if members is None else members
        # what the month and coordinator filters offer is not narrowed by those filters themselves
        self.whole = months is None
        self.months = options.members(self.cube, "mes") if months is None else months
        self.agents = options.agent_options(services) if agents is None else agents
        self.kept = kept

    @classmethod
    def load(cls, spark: SparkSession, paths: Mapping[str, str], **options_) -> ServiceBoard:
        return cls(load_perspectives(spark, paths, **options_))

    @classmethod
    def of_store(cls, spark: SparkSession, path: str) -> ServiceBoard:
        """Over the table that :func:`opsboard.sources.store.ingest` keeps up to date."""
        return cls(store.read_services(spark, path))

    def keep(self) -> ServiceBoard:
        """Compute the cube, the filter members and what is known of accounts once for all further panels.

        They go to the folder all executors share, so no lost executor sends the panels back to the
        extract. The folder is the cluster's to name (``spark.checkpoint.dir``); one on the driver's own disk
        is refused there.
        """
        context = self.cube.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared_folder(self.cube.sparkSession)
        kept = Kept(
            written(distinct.member_bitmaps(self.services, "cuenta"), "accounts"),
            leaders.summarise(self.services, "cuenta"),
            leaders.summarise(self.services, "agente"),
        )
        months = None if self.whole else self.months
        return ServiceBoard(self.services, self.cube.checkpoint(), self.members.checkpoint(), months, self.agents, kept)

    def select(self, chosen: Selection) -> ServiceBoard:
        """The board over a selection. Months, nodes and the cascade on offer stay those of the whole
        board; coordinators are those under the shared filters, whichever of them are chosen."""
        services = apply_selection(self.services, chosen)
        # the cube does not know accounts and coordinators
        cube = None if chosen.cuentas or chosen.coordinadores else apply_selection(self.cube, chosen)
        kept = None if cube is None or self.kept is None else self.kept.where(lambda cells: apply_selection(cells, chosen))
        return ServiceBoard(services, cube, self.members, self.months, options.agent_options(self.services, chosen), kept)

    def breakdown(self, dimension: str, top: int | None = None) -> DataFrame:
        """Participation by one of the board's dimensions."""
        if dimension not in schema.DIMENSIONS:
            raise ValueError(f"no dimension {dimension}; there are {', '.join(schema.DIMENSIONS)}")
        return panels.participation(self.cube if dimension in CUBE_KEYS else self.services, dimension, top)

    def options(self, nodos: tuple[str, ...] = (), paises: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        return {
            "meses": self.months,
            "nodos": options.members(self.members, "nodo"),
            "cascada": options.cascade_options(self.members, nodos, paises),
            "coordinadores": self.agents,
        }

    def panels(self, top_n: int = 15) -> dict[str, DataFrame]:
        kept = self.kept
        return {
            "kpis": distinct.kpi_block(self.cube, kept.accounts) if kept else panels.kpi_block(self.services),
            "estatus": panels.status_share(self.cube),
            "tendencia": panels.monthly_trend(self.cube),
            "nodo": panels.participation(self.cube, "nodo"),
            "mezcla_nodo": panels.status_mix(self.cube, "nodo"),
            "jerarquia": panels.hierarchy_rollup(self.cube),
            "cuentas": leaders.top_members(kept.top_accounts, self.cube, top_n) if kept else panels.top_accounts(self.services, top_n),
            "coordinadores": panels.top_agents(self.services, top_n),
            "detalle": panels.detail_table(self.services),
        }


# ---- registered queries -----------------------------------------------------------------

PICKED = Selection(
    meses=(date(1996, 1, 1), date(1998, 6, 1)),
    nodos=("ASIA", "EUROPE"),
    estatus=("Concluido", "Cancelado posterior"),
    coordinadores=("Supplier#000000002", "Supplier#000000003", "C5", "C6", "(Sin asignar)"),
)

ACCOUNTS = Selection(
    paises=("NATION_10", "NATION_12", "NATION_17", "NATION_2"),
    cuentas=tuple(f"Customer#{k:09d}" for k in range(2, 40, 2)),
)
PAGE = 120

SERVICES_SQL = """
WITH lines AS (
  SELECT r_name AS nodo, n_name AS soa, CAST(c_custkey AS VARCHAR) AS idcuenta,
    CASE WHEN c_custkey % 50 = 0 THEN 'Prueba ' || c_name
         WHEN c_custkey % 50 = 1 THEN 'IKATECH ' || c_name
         WHEN c_custkey % 77 = 5 THEN NULL ELSE c_name END AS cuenta,
    CASE WHEN l_returnflag = 'A' THEN 'Cancelado al momento'
         WHEN l_returnflag = 'R' THEN 'Cancelado posterior'
         WHEN l_linestatus = 'F' THEN 'Concluido' ELSE 'En proceso' END AS estatus,
    CAST(l_quantity AS BIGINT) AS servicios,
    CASE WHEN s_suppkey % 20 = 0 THEN NULL WHEN s_suppkey % 20 = 1 THEN ''
         ELSE ' C' || CAST(s_suppkey AS VARCHAR) END AS coordinador,
    CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN '   '
         ELSE '  ' || s_name || ' ' END AS nombre,
    o_orderdate, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey JOIN supplier ON l_suppkey = s_suppkey
), extracts AS (
  SELECT 'apertura' AS perspectiva, o_orderdate AS periodo, * FROM lines
  UNION ALL SELECT 'gestion', l_shipdate, * FROM lines
), services AS (
  SELECT perspectiva, nodo, soa, cuenta, estatus, servicios,
    CAST(date_trunc('month', periodo) AS DATE) AS mes,
    coalesce(nullif(trim(nombre), ''), nullif(trim(coordinador), ''), '(Sin asignar)') AS agente,
    coalesce(nullif(trim(coordinador), ''), '—') AS coord_code
  FROM extracts
  WHERE NOT coalesce(regexp_matches(cuenta, '(?i)prueba|ikatech|no apertur'), false)
), domain AS (
  SELECT * FROM (VALUES (0, 'Concluido'), (1, 'En proceso'), (2, 'Cancelado al momento'),
                        (3, 'Cancelado posterior')) AS d(ord, estatus)
), totals AS (
  SELECT perspectiva, CAST(sum(servicios) AS BIGINT) AS total FROM services GROUP BY perspectiva
)
"""

_PICKED_SQL = """
  mes BETWEEN DATE '1996-01-01' AND DATE '1998-06-01' AND nodo IN ('ASIA', 'EUROPE')
  AND estatus IN ('Concluido', 'Cancelado posterior')
"""


def _over_services(panel: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: panel(testdata.services(spark, sf_dir))


def _participation_sql(dim: str) -> str:
    return f"""
SELECT g.perspectiva, {dim}, servicios, servicios / total * 100 AS pct
FROM (SELECT perspectiva, {dim}, CAST(sum(servicios) AS BIGINT) AS servicios FROM services
      WHERE {dim} IS NOT NULL GROUP BY ALL) g JOIN totals t ON g.perspectiva = t.perspectiva
"""


def _top_sql(dim: str, n: int) -> str:
    return f"""
SELECT perspectiva, pos, {dim}, servicios, pct FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY perspectiva ORDER BY servicios DESC, {dim}) AS INTEGER) AS pos
  FROM ({_participation_sql(dim)})) WHERE pos <= {n}
"""


def _status_mix_sql(dim: str) -> str:
    return f"""
, member AS (
  SELECT perspectiva, {dim}, CAST(sum(servicios) AS BIGINT) AS total_miembro FROM services
  WHERE {dim} IS NOT NULL GROUP BY ALL
), cell AS (
  SELECT perspectiva, {dim}, estatus, CAST(sum(servicios) AS BIGINT) AS servicios FROM services
  WHERE {dim} IS NOT NULL AND estatus IS NOT NULL GROUP BY ALL
), whole AS (SELECT perspectiva, {dim}, CAST(sum(servicios) AS BIGINT) AS w FROM cell GROUP BY ALL
), used AS (SELECT perspectiva, estatus FROM cell GROUP BY ALL HAVING sum(servicios) <> 0)
SELECT m.perspectiva, m.{dim}, m.total_miembro, d.ord, d.estatus, c.servicios,
  c.servicios / nullif(w.w, 0) * 100 AS pct
FROM member m CROSS JOIN domain d
JOIN used u ON u.perspectiva = m.perspectiva AND u.estatus = d.estatus
LEFT JOIN cell c ON c.perspectiva = m.perspectiva AND c.{dim} = m.{dim} AND c.estatus = d.estatus
LEFT JOIN whole w ON w.perspectiva = m.perspectiva AND w.{dim} = m.{dim}
"""


_DETAIL_SQL = """
SELECT perspectiva, nodo, soa, cuenta, estatus, CAST(sum(servicios) AS BIGINT) AS servicios
FROM services WHERE nodo IS NOT NULL AND soa IS NOT NULL AND cuenta IS NOT NULL AND estatus IS NOT NULL
"""

_PAGES_SQL = f"""
, detail AS ({_DETAIL_SQL} GROUP BY ALL)
SELECT perspectiva, pos, nodo, soa, cuenta, estatus, servicios FROM (
  SELECT *, row_number() OVER (PARTITION BY perspectiva ORDER BY servicios DESC, nodo, soa, cuenta, estatus) AS pos FROM detail)
WHERE pos > {PAGE} AND pos <= {3 * PAGE}
"""

_CLEAN_SQL = """
SELECT perspectiva, count(*) AS filas, CAST(sum(servicios) AS BIGINT) AS servicios,
  count(*) FILTER (cuenta IS NULL) AS sin_cuenta,
  count(*) FILTER (agente = '(Sin asignar)') AS sin_asignar,
  count(*) FILTER (coord_code = '—') AS sin_codigo,
  min(mes) AS primer_mes, max(mes) AS ultimo_mes
FROM services GROUP BY perspectiva
"""

_MEMBER_COUNTS_SQL = """
SELECT perspectiva, count(DISTINCT cuenta) AS cuentas, count(DISTINCT agente) AS agentes,
  count(DISTINCT mes) AS meses FROM services GROUP BY perspectiva
"""

_KPI_SQL = """
SELECT perspectiva, CAST(sum(servicios) AS BIGINT) AS servicios_totales,
  count(DISTINCT cuenta) AS cuentas_activas, count(DISTINCT soa) AS paises,
  CAST(coalesce(sum(servicios) FILTER (estatus = 'Concluido'), 0) AS BIGINT)
    / CAST(sum(servicios) FILTER (estatus IS NOT NULL) AS BIGINT) * 100 AS pct_concluido,
  CAST(coalesce(sum(servicios) FILTER (estatus LIKE 'Cancelado%'), 0) AS BIGINT)
    / CAST(sum(servicios) FILTER (estatus IS NOT NULL) AS BIGINT) * 100 AS pct_cancelado
FROM services GROUP BY perspectiva
"""

_STATUS_SHARE_SQL = """
SELECT perspectiva, ord, estatus, servicios, servicios / total AS participacion,
  CASE WHEN servicios / total >= 0.01 THEN printf('%.1f', servicios / total * 100) || '%' ELSE '' END AS etiqueta
FROM (SELECT *, CAST(sum(servicios) OVER (PARTITION BY perspectiva) AS BIGINT) AS total FROM (
  SELECT perspectiva, ord, estatus, CAST(sum(servicios) AS BIGINT) AS servicios
  FROM services JOIN domain USING (estatus) GROUP BY ALL HAVING sum(servicios) > 0))
"""

_STATUS_TOTALS_SQL = """
SELECT p.perspectiva, d.ord, d.estatus, CAST(coalesce(sum(servicios), 0) AS BIGINT) AS servicios
FROM (SELECT DISTINCT perspectiva FROM services) p CROSS JOIN domain d
LEFT JOIN services s ON s.perspectiva = p.perspectiva AND s.estatus = d.estatus GROUP BY ALL
"""

_TREND_SQL = """
SELECT perspectiva, mes, ord, estatus, servicios FROM (
  SELECT *, sum(servicios) OVER (PARTITION BY perspectiva, estatus) AS serie FROM (
    SELECT perspectiva, mes, ord, estatus, CAST(sum(servicios) AS BIGINT) AS servicios
    FROM services JOIN domain USING (estatus) WHERE mes IS NOT NULL GROUP BY ALL))
WHERE serie <> 0
"""

_HIERARCHY_SQL = """
, leaf AS (
  SELECT perspectiva, nodo, soa, CAST(sum(servicios) AS BIGINT) AS v FROM services
  WHERE nodo IS NOT NULL AND soa IS NOT NULL GROUP BY ALL HAVING sum(servicios) > 0
), node AS (SELECT perspectiva, nodo, CAST(sum(v) AS BIGINT) AS v FROM leaf GROUP BY ALL
), root AS (SELECT perspectiva, CAST(sum(v) AS BIGINT) AS v FROM leaf GROUP BY ALL)
SELECT perspectiva, 0 AS nivel, NULL AS nodo, NULL AS soa, v AS servicios, v / v * 100 AS pct_padre FROM root
UNION ALL
SELECT n.perspectiva, 1, n.nodo, NULL, n.v, n.v / r.v * 100 FROM node n JOIN root r USING (perspectiva)
UNION ALL
SELECT l.perspectiva, 2, l.nodo, l.soa, l.v, l.v / n.v * 100 FROM leaf l JOIN node n USING (perspectiva, nodo)
"""

_TOP_AGENTS_SQL = """
, agent AS (
  SELECT perspectiva, agente, CAST(sum(servicios) AS BIGINT) AS servicios,
    coalesce(array_to_string(list_slice(list_sort(list(DISTINCT coord_code) FILTER (coord_code <> '—')), 1, 3),
             '/'), '—') AS codigo
  FROM services GROUP BY ALL)
SELECT perspectiva, pos, agente, codigo, servicios, pct FROM (
  SELECT a.*, servicios / total * 100 AS pct, CAST(row_number() OVER (
    PARTITION BY a.perspectiva ORDER BY servicios DESC, agente) AS INTEGER) AS pos
  FROM agent a JOIN totals t ON a.perspectiva = t.perspectiva) WHERE pos <= 15
"""

_CASCADE_SQL = """
, offered AS (SELECT DISTINCT soa FROM services WHERE nodo IN ('ASIA', 'EUROPE') AND soa IS NOT NULL)
SELECT 'pais' AS nivel, soa AS opcion FROM offered
UNION ALL
SELECT DISTINCT 'cuenta', cuenta FROM services WHERE cuenta IS NOT NULL AND soa IN (SELECT soa FROM offered)
"""

_RECONCILIATION_SQL = """
, months AS (
  SELECT coalesce(a.mes, g.mes) AS mes, coalesce(a.s, 0) AS apertura, coalesce(g.s, 0) AS gestion FROM
    (SELECT mes, CAST(sum(servicios) AS BIGINT) AS s FROM services WHERE perspectiva = 'apertura' GROUP BY mes) a
  FULL OUTER JOIN
    (SELECT mes, CAST(sum(servicios) AS BIGINT) AS s FROM services WHERE perspectiva = 'gestion' GROUP BY mes) g
  ON a.mes = g.mes)
SELECT mes, apertura, gestion, apertura - gestion AS diferencia,
  CAST(sum(apertura - gestion) OVER (ORDER BY mes) AS BIGINT) AS diferencia_acumulada FROM months
"""

_SUMMARY_SQL = """
SELECT 'total' AS panel, perspectiva, CAST(NULL AS DATE) AS mes, NULL AS nodo, NULL AS soa, NULL AS estatus,
  CAST(sum(servicios) AS BIGINT) AS servicios FROM services GROUP BY perspectiva
UNION ALL SELECT 'estatus', perspectiva, NULL, NULL, NULL, estatus, CAST(sum(servicios) AS BIGINT)
  FROM services GROUP BY perspectiva, estatus
UNION ALL SELECT 'tendencia', perspectiva, mes, NULL, NULL, estatus, CAST(sum(servicios) AS BIGINT)
  FROM services GROUP BY perspectiva, mes, estatus
UNION ALL SELECT 'nodo', perspectiva, NULL, nodo, NULL, NULL, CAST(sum(servicios) AS BIGINT)
  FROM services GROUP BY perspectiva, nodo
UNION ALL SELECT 'mezcla', perspectiva, NULL, nodo, NULL, estatus, CAST(sum(servicios) AS BIGINT)
  FROM services GROUP BY perspectiva, nodo, estatus
UNION ALL SELECT 'jerarquia', perspectiva, NULL, nodo, soa, NULL, CAST(sum(servicios) AS BIGINT)
  FROM services GROUP BY perspectiva, nodo, soa
"""


def _filtered_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    # loaded per extract, so each period filter reaches the scan of its own date column
    return panels.detail_table(apply_selection(testdata.services_by_extract(spark, sf_dir), PICKED))


def _empty_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nowhere = Selection(nodos=("NOWHERE",))
    return panels.detail_table(apply_selection(testdata.services(spark, sf_dir), nowhere))


def _clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.clean_summary(testdata.services(spark, sf_dir))


def _agent_options(services: DataFrame) -> DataFrame:
    return options.agent_options(services, Selection(meses=PICKED.meses, nodos=PICKED.nodos, estatus=PICKED.estatus))


def _board_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the filters of a board offer once a period and nodes are chosen, as one list."""
    board = ServiceBoard(testdata.services(spark, sf_dir)).select(Selection(meses=PICKED.meses, nodos=PICKED.nodos))
    offered = board.options(PICKED.nodos, ("NATION_10", "NATION_19"))
    lists = [
        offered["meses"].select(F.lit("mes").alias("nivel"), F.col("mes").cast("string").alias("opcion")),
        offered["nodos"].select(F.lit("nodo").alias("nivel"), F.col("nodo").alias("opcion")),
        offered["cascada"],
        offered["coordinadores"].select(F.lit("coordinador").alias("nivel"), F.col("agente").alias("opcion")),
    ]
    return reduce(DataFrame.unionByName, lists)


_BOARD_OPTIONS_SQL = """
SELECT DISTINCT 'mes' AS nivel, CAST(mes AS VARCHAR) AS opcion FROM services WHERE mes IS NOT NULL
UNION ALL SELECT DISTINCT 'nodo', nodo FROM services WHERE nodo IS NOT NULL
UNION ALL SELECT DISTINCT 'pais', soa FROM services WHERE nodo IN ('ASIA', 'EUROPE') AND soa IS NOT NULL
UNION ALL SELECT DISTINCT 'cuenta', cuenta FROM services WHERE soa IN ('NATION_10', 'NATION_19') AND cuenta IS NOT NULL
UNION ALL SELECT DISTINCT 'coordinador', agente FROM services
  WHERE mes BETWEEN DATE '1996-01-01' AND DATE '1998-06-01' AND nodo IN ('ASIA', 'EUROPE')
"""


def _cube_kpi_block(services: DataFrame) -> DataFrame:
    return distinct.kpi_block(monthly_cube(services), written(distinct.member_bitmaps(services, "cuenta"), "accounts"))


def _cube_cases(services: DataFrame) -> DataFrame:
    """Services per coordinator and node, for every year, from the cube and bitmaps of coordinators."""
    cube, agents = written(monthly_cube(services), "cube"), written(distinct.member_bitmaps(services, "agente"), "agents")
    by = ["perspectiva", "nodo", "anio"]
    dated = [df.filter("mes IS NOT NULL").withColumn("anio", F.year("mes")) for df in (cube, agents)]
    return distinct.per_entity(*dated, by)


_CUBE_CASES_SQL = """
SELECT perspectiva, nodo, anio, medida, entidades, medida / entidades AS por_entidad FROM (
  SELECT perspectiva, nodo, CAST(year(mes) AS INTEGER) AS anio, CAST(sum(servicios) AS BIGINT) AS medida,
    count(DISTINCT agente) AS entidades FROM services WHERE mes IS NOT NULL GROUP BY ALL)
"""


def _leaders(member: str, n: int) -> Callable[[DataFrame], DataFrame]:
    return lambda services: leaders.top_members(leaders.summarise(services, member), monthly_cube(services), n)


def _concentration(services: DataFrame) -> DataFrame:
    return leaders.concentration(leaders.summarise(services, "cuenta"), monthly_cube(services), 10)


_CONCENTRATION_SQL = """
, best AS (SELECT perspectiva, cuenta, CAST(sum(servicios) AS BIGINT) AS s FROM services WHERE cuenta IS NOT NULL GROUP BY ALL),
first AS (SELECT perspectiva, CAST(sum(s) AS DOUBLE) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY perspectiva ORDER BY s DESC, cuenta) AS n FROM best) WHERE n <= 10 GROUP BY ALL)
SELECT perspectiva, top, CAST(total AS DOUBLE) AS total, top / total AS concentracion
FROM first JOIN totals USING (perspectiva)
"""


def _extract_files(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The extracts as packed CSV files in the shared folder, with unlike headers. The one of handled services has the
    rows of a fifth of the accounts twice, once with a date nobody can read.

    A packed file is read by one task, so a file has a million rows at most."""
    folder, moment = new_path(spark, "extracts"), "PERIODO GESTION"
    as_is = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    packed = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 1_000_000}
    paths = {view: f"{folder}/{view}" for view in schema.PERSPECTIVES}
    for view, path in paths.items():
        raw = testdata.raw_extract(spark, sf_dir, view).drop("perspectiva")
        raw = raw.withColumn(moment, F.col(f"`{moment}`").cast("string"))
        if view == "gestion":
            twice = F.when(F.col("`ID CUENTA`").cast("long") % 5 == 1, F.array(F.col(f"`{moment}`"), F.lit("por confirmar")))
            dates = twice.otherwise(F.array(F.col(f"`{moment}`")))
            raw = raw.select(*[F.explode(dates).alias(c) if c == moment else F.col(f"`{c}`") for c in raw.columns])
            raw = raw.withColumn("OBSERVACION", F.lit("x"))
        else:
            raw = raw.select(*sorted(raw.columns))
        with shuffles_let_go(spark):
            raw.write.options(**as_is, **packed).csv(path)
    return paths


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, store.Load]:
    path = new_path(spark, "store")
    return path, store.ingest(spark, path, _extract_files(spark, sf_dir), fmt="csv")


_STORE_COUNTS_SQL = (
    SERVICES_SQL
    + """
, told AS (SELECT *, coalesce(regexp_matches(cuenta, '(?i)prueba|ikatech|no apertur'), false) AS test FROM extracts),
twice AS (SELECT * FROM told WHERE perspectiva = 'gestion' AND CAST(idcuenta AS BIGINT) % 5 = 1)
SELECT perspectiva, 'fecha' AS motivo, count(*) AS filas FROM twice WHERE NOT test GROUP BY perspectiva
UNION ALL SELECT perspectiva, 'cargada', count(*) FROM services GROUP BY perspectiva
UNION ALL SELECT NULL, 'prueba', (SELECT count(*) FROM told WHERE test) + (SELECT count(*) FROM twice WHERE test)
"""
)


def _store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.clean_summary(store.read_services(spark, _stored(spark, sf_dir)[0]))


def _store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger and the rejects of a load, summed up."""
    path, load = _stored(spark, sf_dir)
    rejects = store.read_rejects(spark, path).groupBy("perspectiva", "motivo").agg(F.count(F.lit(1)).alias("filas"))
    ledger = store.read_ledger(spark, path).groupBy("perspectiva").agg(F.sum("cargadas").alias("filas"))
    tests = spark.range(1).select(F.lit(None).cast("string").alias("perspectiva"), F.lit("prueba").alias("motivo"), F.lit(load.pruebas).cast("long").alias("filas"))
    return rejects.unionByName(ledger.select("perspectiva", F.lit("cargada").alias("motivo"), "filas")).unionByName(tests)


def _store_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail of one account from a laid-out table."""
    path = new_path(spark, "services")
    export.write_services(testdata.services(spark, sf_dir), path)
    laid = spark.read.schema(schema.SERVICES).parquet(path)
    return panels.detail_table(apply_selection(laid, Selection(cuentas=ACCOUNTS.cuentas[:1])))


def _exported_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail table, out to CSV and back."""
    path = new_path(spark, "detail")
    detail = panels.detail_table(testdata.services(spark, sf_dir))
    export.write_detail_csv(detail, path)
    return export.read_detail_csv(spark, path)


def _detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of each perspective, and the page behind it by its last row."""
    path = new_path(spark, "pages")
    paging.write_pages(panels.detail_table(testdata.services(spark, sf_dir)), path, block_rows=500)
    shown = []
    for view in schema.PERSPECTIVES:
        second = paging.page(spark, path, view, 2, PAGE)
        last = second.orderBy(F.col("pos").desc()).first()  # one row
        shown += [second, paging.page_after(spark, path, view, last.asDict(), PAGE)] if last else [second]
    return reduce(DataFrame.unionByName, shown)


def _s(panel: Callable[[DataFrame], DataFrame], sql: str) -> Query:
    return Query(_over_services(panel), SERVICES_SQL + sql)


QUERIES: dict[str, Query] = {
    "svc_clean_summary": Query(_clean_summary, SERVICES_SQL + _CLEAN_SQL),
    "svc_member_counts": _s(panels.member_counts, _MEMBER_COUNTS_SQL),
    "svc_kpi_block": _s(panels.kpi_block, _KPI_SQL),
    "svc_status_share": _s(panels.status_share, _STATUS_SHARE_SQL),
    "svc_status_totals": _s(panels.status_totals, _STATUS_TOTALS_SQL),
    "svc_monthly_trend": _s(panels.monthly_trend, _TREND_SQL),
    "svc_participation_nodo": _s(lambda s: panels.participation(s, "nodo"), _participation_sql("nodo")),
    "svc_participation_soa": _s(lambda s: panels.participation(s, "soa"), _participation_sql("soa")),
    "svc_participation_agente": _s(lambda s: panels.participation(s, "agente"), _participation_sql("agente")),
    "svc_participation_cuenta": _s(lambda s: panels.participation(s, "cuenta"), _participation_sql("cuenta")),
    "svc_top_accounts": _s(lambda s: panels.top_accounts(s, 15), _top_sql("cuenta", 15)),
    "svc_status_mix_nodo": _s(lambda s: panels.status_mix(s, "nodo"), _status_mix_sql("nodo")),
    "svc_status_mix_soa": _s(lambda s: panels.status_mix(s, "soa"), _status_mix_sql("soa")),
    "svc_status_mix_agente": _s(lambda s: panels.status_mix(s, "agente"), _status_mix_sql("agente")),
    "svc_hierarchy": _s(panels.hierarchy_rollup, _HIERARCHY_SQL),
    "svc_top_agents": _s(lambda s: panels.top_agents(s, 15), _TOP_AGENTS_SQL),
    "svc_detail": _s(panels.detail_table, _DETAIL_SQL + " GROUP BY ALL"),
    "svc_filtered_detail": Query(
        _filtered_detail,
        SERVICES_SQL
        + _DETAIL_SQL
        + f" AND {_PICKED_SQL} AND agente IN ('Supplier#000000002', 'Supplier#000000003', 'C5', 'C6', '(Sin asignar)')"
        + " GROUP BY ALL",
    ),
    "svc_empty_filter": Query(_empty_filter, SERVICES_SQL + _DETAIL_SQL + " AND nodo = 'NOWHERE' GROUP BY ALL"),
    "svc_nodos": _s(
        lambda s: options.members(s, "nodo"), "SELECT DISTINCT nodo FROM services WHERE nodo IS NOT NULL"
    ),
    "svc_nodo_paises": _s(
        lambda s: options.membership(s, "nodo", "soa"),
        "SELECT DISTINCT nodo, soa FROM services WHERE nodo IS NOT NULL AND soa IS NOT NULL",
    ),
    "svc_pais_cuentas": _s(
        lambda s: options.membership(s, "soa", "cuenta"),
        "SELECT DISTINCT soa, cuenta FROM services WHERE soa IS NOT NULL AND cuenta IS NOT NULL",
    ),
    "svc_month_domain": _s(
        lambda s: options.members(s, "mes"), "SELECT DISTINCT mes FROM services WHERE mes IS NOT NULL"
    ),
    "svc_cascade_options": _s(lambda s: options.cascade_options(options.hierarchy_members(s), ("ASIA", "EUROPE")), _CASCADE_SQL),
    "svc_cascade_countries": _s(
        lambda s: options.cascade_options(options.hierarchy_members(s), ("ASIA", "EUROPE"), ("NATION_10", "NATION_19")),
        _CASCADE_SQL.replace("soa IN (SELECT soa FROM offered)", "soa IN ('NATION_10', 'NATION_19')"),
    ),
    "svc_chosen_accounts": _s(
        lambda s: panels.detail_table(apply_selection(s, ACCOUNTS)),
        _DETAIL_SQL + f" AND soa IN {ACCOUNTS.paises} AND cuenta IN {ACCOUNTS.cuentas} GROUP BY ALL",
    ),
    "svc_board_options": Query(_board_options, SERVICES_SQL + _BOARD_OPTIONS_SQL),
    "svc_cube_kpi_block": _s(_cube_kpi_block, _KPI_SQL),
    "svc_cube_cases_per_agent": _s(_cube_cases, _CUBE_CASES_SQL),
    "svc_leaders_accounts": _s(_leaders("cuenta", 15), _top_sql("cuenta", 15)),
    "svc_leaders_accounts_1200": _s(_leaders("cuenta", 1200), _top_sql("cuenta", 1200)),
    "svc_leaders_agents": _s(_leaders("agente", 40), _top_sql("agente", 40)),
    "svc_leaders_concentration": _s(_concentration, _CONCENTRATION_SQL),
    "svc_store_summary": Query(_store_summary, SERVICES_SQL + _CLEAN_SQL),
    "svc_store_counts": Query(_store_counts, _STORE_COUNTS_SQL),
    "svc_store_account": Query(
        _store_account, SERVICES_SQL + _DETAIL_SQL + f" AND cuenta = '{ACCOUNTS.cuentas[0]}' GROUP BY ALL"
    ),
    "svc_exported_detail": Query(_exported_detail, SERVICES_SQL + _DETAIL_SQL + " GROUP BY ALL"),
    "svc_detail_pages": Query(_detail_pages, SERVICES_SQL + _PAGES_SQL),
    "svc_agent_options": _s(
        _agent_options,
        "SELECT agente, CAST(sum(servicios) AS BIGINT) AS servicios FROM services "
        f"WHERE {_PICKED_SQL} GROUP BY agente",
    ),
    "svc_reconciliation": _s(panels.reconciliation, _RECONCILIATION_SQL),
    "svc_board_summary": _s(lambda s: board_summary(monthly_cube(s)), _SUMMARY_SQL),
}
