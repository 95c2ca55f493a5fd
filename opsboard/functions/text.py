"""Text rules of the services extract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opsboard import schema

# Everything Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Drop white space at both ends; plain ``trim`` would drop blanks only."""
    return F.btrim(text, F.lit(WHITESPACE))


def _filled(text: Column) -> Column:
    """Blank counts as missing."""
    return F.nullif(text, F.lit(""))


def coordinator_name(nombre: Column, code: Column) -> Column:
    """Name, else code, else the unassigned marker; both already stripped."""
    return F.coalesce(_filled(nombre), _filled(code), F.lit(schema.UNASSIGNED))


def coordinator_code(code: Column) -> Column:
    return F.coalesce(_filled(code), F.lit(schema.NO_CODE))


def is_test_account(cuenta: Column, pattern: str = schema.TEST_ACCOUNTS) -> Column:
    """True for accounts to leave out. A null account is a real one."""
    return F.coalesce(cuenta.rlike(pattern), F.lit(False))
