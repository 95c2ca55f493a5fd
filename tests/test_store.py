"""The service store: loading once, file by file; rejects and counts; layout that skips."""

import datetime as dt
import glob
import json
import os
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from opsboard import schema, storage
from opsboard.operators.filters import Selection, apply_selection
from opsboard.plans import service_board, testdata
from opsboard.plans.service_board import ServiceBoard
from opsboard.sources import export, services as source, store

NAMES = schema.RAW_SERVICES.names
MONTHS = ("2025-01-15", "2025-02-15", "2025-03-15")


def line(cuenta="C1", servicios="1", periodo="2025-01-15", nodo="N1", nombre="Ana", **other):
    values = dict(zip(NAMES, [nodo, "gt", "007", cuenta, "Concluido", servicios, periodo, "012", nombre]))
    return values | other


def write(path, rows, names=NAMES):
    text = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') else v
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(",".join(names) + "\n" + "".join(",".join(text(r.get(n, "")) for n in names) + "\n" for r in rows))


def stamp(path, when):
    os.utime(path, (when, when))


@pytest.fixture
def folder(tmp_path):
    for n, month in enumerate(MONTHS[:2]):
        write(f"{tmp_path}/in/{n}.csv", [line(f"C{k}", str(k + 1), month) for k in range(4)] + [line("PRUEBA", periodo=month)])
    return tmp_path


def ingest(spark, folder):
    return store.ingest(spark, f"{folder}/store", {"apertura": f"{folder}/in"}, fmt="csv")


def parts(folder):
    """Files of the table by month."""
    found = {}
    for path in glob.glob(f"{folder}/store/servicios/perspectiva=*/mes=*/*.parquet"):
        found.setdefault(os.path.basename(os.path.dirname(path)).removeprefix("mes="), set()).add(os.path.basename(path))
    return found


def content(df):
    return sorted((tuple(r) for r in df.select("cuenta", "servicios", "mes", "agente").collect()), key=repr)


def whole(spark, folder):
    return source.load_services(spark, f"{folder}/in", "apertura", "csv", bad_dates="null")


def test_a_new_file_rewrites_only_its_months(spark, folder):
    first = ingest(spark, folder)
    assert (first.archivos, first.filas, first.pruebas, first.cargadas) == (2, 10, 2, 8)
    before = parts(folder)
    assert set(before) == {"2025-01-01", "2025-02-01"}
    assert ingest(spark, folder).archivos == 0 and parts(folder) == before
    write(f"{folder}/in/late.csv", [line("C9", "5", MONTHS[1]), line("C9", "6", MONTHS[2])])
    second = ingest(spark, folder)
    assert second.archivos == 1 and second.meses == (("apertura", dt.date(2025, 2, 1)), ("apertura", dt.date(2025, 3, 1)))
    after = parts(folder)
    assert after["2025-01-01"] == before["2025-01-01"] and not after["2025-02-01"] & before["2025-02-01"] and len(after) == 3
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))
    ledger = {os.path.basename(r["archivo"]): (r["cargadas"], len(r["meses"])) for r in store.read_ledger(spark, f"{folder}/store").collect()}
    assert ledger == {"0.csv": (4, 1), "1.csv": (4, 1), "late.csv": (2, 2)}


def test_a_changed_file_gives_up_its_old_rows(spark, folder):
    ingest(spark, folder)
    write(f"{folder}/in/1.csv", [line("C7", "70", MONTHS[2]), line("C8", "1", "")])
    stamp(f"{folder}/in/1.csv", 2_000_000_000)
    load = ingest(spark, folder)
    assert {m for _, m in load.meses} == {dt.date(2025, 2, 1), dt.date(2025, 3, 1), None}
    # February came from that file alone and is gone; rows without a month have a place of their own
    assert set(parts(folder)) == {"2025-01-01", "2025-03-01", "__HIVE_DEFAULT_PARTITION__"}
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))
    write(f"{folder}/in/1.csv", [line("C7", "71", MONTHS[2])])
    stamp(f"{folder}/in/1.csv", 2_000_000_100)
    ingest(spark, folder)
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))
    assert store.read_ledger(spark, f"{folder}/store").count() == 2
    os.remove(f"{folder}/in/0.csv")
    held = content(store.read_services(spark, f"{folder}/store"))
    assert ingest(spark, folder).archivos == 0 and content(store.read_services(spark, f"{folder}/store")) == held


@pytest.mark.parametrize("after", ["nothing", "services", "rejects"])
def test_a_load_that_was_cut_off_is_finished(spark, folder, monkeypatch, after):
    ingest(spark, folder)
    write(f"{folder}/in/late.csv", [line("C9", "5", MONTHS[1]), line("C9", "soon", MONTHS[1])])
    steps, real = [], store.write_services

    def cut(*args, **options):
        if after != "nothing":
            real(*args, **options)
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "write_services", cut)
    with pytest.raises(RuntimeError):
        ingest(spark, folder)
    monkeypatch.setattr(store, "write_services", real)
    if after == "rejects":  # as far as the ledger, and again
        monkeypatch.setattr(store, "delete", lambda *a: steps.append(a))
    assert store.finish(spark, f"{folder}/store") and not store.finish(spark, f"{folder}/store")
    assert ingest(spark, folder).archivos == 0
    rows = [r for r in content(store.read_services(spark, f"{folder}/store")) if r[0] == "C9"]
    assert rows == [("C9", 5, dt.date(2025, 2, 1), "Ana")]
    assert [r["motivo"] for r in store.read_rejects(spark, f"{folder}/store").collect()] == ["cantidad"]


def test_rejects_are_kept_and_counts_add_up(spark, folder):
    rows = [line("A"), line("B", periodo="soon"), line("C", servicios="many"), line("PRUEBA 1", periodo="soon"), line("D", periodo=""), line("E", servicios="")]
    write(f"{folder}/in/2.csv", rows)
    load = ingest(spark, folder)
    assert (load.filas, load.pruebas, load.fechas, load.cantidades, load.cargadas) == (16, 3, 1, 1, 11)
    rejects = store.read_rejects(spark, f"{folder}/store").collect()
    assert sorted((r["motivo"], json.loads(r["crudo"])["CUENTA"]) for r in rejects) == [("cantidad", "C"), ("fecha", "B")]
    assert json.loads(rejects[0]["crudo"]).keys() == set(NAMES)
    write(f"{folder}/in/2.csv", [line("B")])
    stamp(f"{folder}/in/2.csv", 2_000_000_000)
    ingest(spark, folder)
    assert store.read_rejects(spark, f"{folder}/store").count() == 0


def test_one_scan_gives_rows_rejects_and_counts(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", [line("A"), line("B", periodo="soon")])
    raw = spark.read.option("header", True).csv(f"{tmp_path}/in")
    sorted_rows = source.sorted_out(raw, Observation())
    plan = sorted_rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and plan.count("CollectMetrics") == 1


def test_board_of_a_store_is_that_of_the_extract(spark, folder):
    write(f"{folder}/in/3.csv", [line("C1", "9", MONTHS[2], nodo="N2", nombre="")])
    ingest(spark, folder)
    ours, theirs = ServiceBoard.of_store(spark, f"{folder}/store"), ServiceBoard(whole(spark, folder))
    for name, panel in theirs.panels(3).items():
        assert sorted(map(repr, ours.panels(3)[name].collect())) == sorted(map(repr, panel.collect())), name


def test_nothing_loaded_and_unknown_perspectives(spark, tmp_path):
    assert store.read_services(spark, f"{tmp_path}/none").columns == schema.SERVICES.names
    assert store.read_services(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError, match="no perspective"):
        store.ingest(spark, f"{tmp_path}/none", {"otra": str(tmp_path)})


# ---- extracts -----------------------------------------------------------------------------


def test_csv_columns_are_found_by_name_file_by_file(spark, tmp_path):
    write(f"{tmp_path}/in/a b%20.csv", [line("first", "1")])
    write(f"{tmp_path}/in/b.csv", [line("other order", "2")], NAMES[::-1])
    write(f"{tmp_path}/in/c.csv", [line("extra", "3", NOTA="x", **{"": "y"})], ["NOTA", "", *NAMES, "NOTA"])
    write(f"{tmp_path}/in/d.csv", [line("broken", "4", nombre='two\nlines, "both" his')])
    with open(f"{tmp_path}/in/e.csv", "w", encoding="utf-8") as file:
        file.write("")
    with open(f"{tmp_path}/in/f.csv", "w", encoding="utf-8-sig") as file:
        file.write(",".join(NAMES) + "\r\n" + ",".join(line("mark", "5").values()) + "\r\n")
    rows = source.load_services(spark, f"{tmp_path}/in", "apertura", "csv")
    got = {r["cuenta"]: (r["servicios"], r["idcuenta"], r["agente"]) for r in rows.collect()}
    assert got == {
        "first": (1, "007", "Ana"), "other order": (2, "007", "Ana"), "extra": (3, "007", "Ana"),
        "broken": (4, "007", 'two\nlines, "both" his'), "mark": (5, "007", "Ana"),
    }
    signatures = source.csv_signatures(spark, f"{tmp_path}/in").collect()
    assert {os.path.basename(r["ruta"]): r["partido"] for r in signatures} == {"a b%20.csv": False, "b.csv": False, "c.csv": False, "d.csv": True, "f.csv": False}


def test_a_missing_column_is_named(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", [line()], NAMES[1:])
    with pytest.raises(ValueError, match="a.csv lacks the columns NODO"):
        source.read_extract(spark, f"{tmp_path}/in", "csv")
    spark.sql("SELECT 1 AS NODO").write.parquet(f"{tmp_path}/p")
    with pytest.raises(ValueError, match="lacks the columns SOA, ID CUENTA"):
        source.read_extract(spark, f"{tmp_path}/p")
    os.makedirs(f"{tmp_path}/empty")
    write(f"{tmp_path}/empty/a.csv", [])
    assert source.load_services(spark, f"{tmp_path}/empty", "apertura", "csv").count() == 0


def test_codes_that_arrive_as_fractions_stay_whole(spark):
    raw = spark.createDataFrame(
        [("N", "gt", 12345678.0, "C", "Concluido", 2.0, dt.datetime(2025, 1, 1), 12.0, "Ana"), ("N", "gt", None, "C", "Concluido", 1.0, None, 1.5, None)],
        "NODO string, SOA string, `ID CUENTA` double, CUENTA string, STATUS string, `# SERVICIOS` double, `PERIODO GESTION` timestamp_ntz, COORDINADOR double, NOMBRE string",
    )
    got = [(r["idcuenta"], r["coordinador"], r["servicios"]) for r in source.canonical(raw).collect()]
    assert got == [("12345678", "12", 2), (None, "1.5", 1)]


# ---- layout -------------------------------------------------------------------------------


def scanned(df):
    """Rows that the file scan handed on."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numOutputRows"))


@pytest.mark.parametrize("chosen", [Selection(cuentas=("C77",)), Selection(nodos=("N3",), cuentas=("C123",)), Selection(coordinadores=("A5",))])
def test_row_groups_without_the_account_are_skipped(spark, tmp_path, chosen):
    rows = spark.range(60_000).selectExpr(
        "'apertura' AS perspectiva", "concat('N', id % 7) AS nodo", "'gt' AS soa", "cast(id % 400 as string) AS idcuenta",
        "concat('C', id % 400) AS cuenta", "'Concluido' AS estatus", "1L AS servicios", "timestamp_ntz'2025-01-15 00:00:00' AS periodo",
        "date'2025-01-01' AS mes", "'x' AS coordinador", "'x' AS nombre", "concat('A', id % 211) AS agente", "'x' AS coord_code",
    )
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.files.maxRecordsPerFile": "2000"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        export.write_services(rows, f"{tmp_path}/laid")
        rows.orderBy(F.rand(1)).write.parquet(f"{tmp_path}/plain")
        laid = apply_selection(spark.read.parquet(f"{tmp_path}/laid"), chosen).select("servicios")
        plain = apply_selection(spark.read.parquet(f"{tmp_path}/plain"), chosen).select("servicios")
        assert laid.count() == plain.count() > 0
        assert scanned(laid) < 0.6 * scanned(plain) and scanned(plain) > 0.9 * rows.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_the_shared_folder_is_the_clusters(spark, monkeypatch):
    class Context:
        master, given, own = "spark://host:7077", None, None

        def getConf(self):
            return {"spark.checkpoint.dir": self.given} if self.given else {}

        def getCheckpointDir(self):
            return self.own

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    Context.own = "file:/tmp/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session())
    Context.own = "hdfs://x/y/"
    assert storage.shared_folder(Session()) == "hdfs://x/y"
    Context.given = "file:///shared/z"
    assert storage.shared_folder(Session()) == "file:///shared/z"


def test_empty_files_are_loaded_too(spark, tmp_path):
    write(f"{tmp_path}/in/header.csv", [])
    with open(f"{tmp_path}/in/nothing.csv", "w", encoding="utf-8"):
        pass
    load = ingest(spark, tmp_path)
    assert (load.archivos, load.filas, load.cargadas, load.meses) == (1, 0, 0, ())  # a file without a byte is no file to Spark
    assert store.read_services(spark, f"{tmp_path}/store").count() == 0 and store.read_ledger(spark, f"{tmp_path}/store").count() == 1
    assert ingest(spark, tmp_path).archivos == 0
    os.makedirs(f"{tmp_path}/other")
    with open(f"{tmp_path}/other/nothing.csv", "w", encoding="utf-8"):
        pass
    assert store.ingest(spark, f"{tmp_path}/store", {"gestion": f"{tmp_path}/other"}, fmt="csv").filas == 0


def test_lines_are_not_sorted_for_their_header(spark, folder):
    plan = source.csv_signatures(spark, f"{folder}/in")._jdf.queryExecution().executedPlan().toString()
    assert "min_by" in plan and "SortAggregate" not in plan


def test_rows_are_put_aside_only_where_other_files_keep_them(spark, folder):
    ingest(spark, folder)
    assert spark.read.parquet(f"{folder}/store/restos").count() == 0
    write(f"{folder}/in/late.csv", [line("C9", "5", MONTHS[1])])
    ingest(spark, folder)
    assert spark.read.parquet(f"{folder}/store/restos").count() == 4  # those of 1.csv
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))


# ---- disk ---------------------------------------------------------------------------------


def shuffled(spark):
    """Shuffle files on this machine's disks."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().endswith(".data")}


def test_extracts_are_packed_and_leave_no_shuffle(spark, sf_dir):
    before, setting = shuffled(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)
    paths = service_board._extract_files(spark, sf_dir)
    until = time.time() + 20
    while (left := shuffled(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(setting, None) == was
    for view, path in paths.items():
        files = [f for f in glob.glob(f"{path}/*") if not os.path.basename(f).startswith("_")]
        assert files and all(f.endswith(".csv.gz") for f in files)
        raw = source.read_extract(spark, path, "csv")
        times = F.when((F.col("`ID CUENTA`") % 5 == 1) & (F.lit(view) == "gestion"), 2).otherwise(1)
        assert raw.count() == testdata.raw_extract(spark, sf_dir, view).agg(F.sum(times)).first()[0] > 0


def test_months_are_written_some_at_a_time(spark, folder, monkeypatch):
    write(f"{folder}/in/2.csv", [line("C1", str(k), f"2026-{k:02d}-03") for k in range(1, 13)] + [line("C2", periodo="")])
    sizes, real = [], store.write_services

    def counted(rows, *args, **options):
        sizes.append(rows.count())
        real(rows, *args, **options)

    monkeypatch.setattr(store, "write_services", counted)
    monkeypatch.setattr(store, "ROWS_AT_A_TIME", 5)
    load = ingest(spark, folder)
    assert len(sizes) > 3 and max(sizes) <= 5 and sum(sizes) == load.cargadas == 21
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))
    write(f"{folder}/in/1.csv", [line("C7", "70", "2026-05-01")])
    stamp(f"{folder}/in/1.csv", 2_000_000_000)
    ingest(spark, folder)
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))


def test_batches_hold_every_month_once(monkeypatch):
    monkeypatch.setattr(store, "ROWS_AT_A_TIME", 10)
    months = {("gestion", dt.date(2024 + n // 12, n % 12 + 1, 1)): 1 + n // 12 * n for n in range(24)}
    months |= {("apertura", None): 4, ("apertura", dt.date(2024, 2, 1)): 3, ("apertura", dt.date(2023, 2, 1)): 3}
    batches = store._batches(months)
    assert sorted((m for b in batches for m in b), key=repr) == sorted(months, key=repr)
    assert all(len(b) == 1 or sum(months[m] for m in b) <= 10 for b in batches)
    assert batches[0] == (("apertura", dt.date(2023, 2, 1)), ("apertura", dt.date(2024, 2, 1)), ("apertura", None))
    assert store._batches({}) == []


def test_a_load_put_down_in_one_folder_is_finished(spark, folder, monkeypatch):
    def cut(*args, **options):
        raise RuntimeError("lost")

    real = store.write_services
    monkeypatch.setattr(store, "write_services", cut)
    with pytest.raises(RuntimeError):
        ingest(spark, folder)
    monkeypatch.setattr(store, "write_services", real)
    entered = spark.read.parquet(f"{folder}/store/entrada").drop("anio").collect()
    struct = spark.read.parquet(f"{folder}/store/entrada").drop("anio").schema
    spark.createDataFrame(entered, struct).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/store/entrada")
    assert store.finish(spark, f"{folder}/store")
    assert content(store.read_services(spark, f"{folder}/store")) == content(whole(spark, folder))
