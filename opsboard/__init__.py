"""opsboard: service and KPI reporting as plain Spark DataFrame operators."""
