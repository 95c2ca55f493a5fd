import datetime as dt
import os

import pytest

from opsboard import schema
from opsboard.session import local_session
from opsboard.sources.dictionaries import small_table

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def services(spark):
    """Clean services from a few dicts; what a row does not say gets a plain value."""

    def make(*rows):
        plain = {
            "perspectiva": "gestion",
            "nodo": "N1",
            "soa": "P1",
            "idcuenta": "1",
            "cuenta": "C1",
            "estatus": schema.CONCLUDED,
            "servicios": 1,
            "periodo": dt.datetime(2025, 1, 15),
            "mes": dt.date(2025, 1, 1),
            "coordinador": None,
            "nombre": None,
            "agente": "A1",
            "coord_code": schema.NO_CODE,
        }
        filled = [{**plain, **row} for row in rows]
        return small_table(spark, [tuple(r[n] for n in schema.SERVICES.names) for r in filled], schema.SERVICES)

    return make


@pytest.fixture
def rows():
    """Rows of a frame as plain tuples of the named columns, in order."""

    def read(df, *columns):
        return [tuple(r) for r in df.select(*columns).collect()]

    return read
