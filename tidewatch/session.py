"""Sessions: UTC, adaptive execution, Arrow; and table access that always names a tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(name: str = "tidewatch", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=defaults | settings).getOrCreate()


class Tenant:
    """The only way to a tenant's tables: every frame that it hands out is filtered by tenant, and analysis if given."""

    def __init__(self, spark: SparkSession, root: str, tenant_id: str, analysis_id: str | None = None):
        if not tenant_id:
            raise ValueError("a tenant is needed")
        self.spark, self.root, self.tenant_id, self.analysis_id = spark, root, tenant_id, analysis_id

    def table(self, name: str) -> DataFrame:
        found = self.spark.read.parquet(f"{self.root}/{name}")
        if "tenant_id" not in found.columns:
            raise ValueError(f"{name} has no tenant_id")
        found = found.filter(F.col("tenant_id") == self.tenant_id)
        if self.analysis_id is not None and "analysis_id" in found.columns:
            found = found.filter(F.col("analysis_id") == self.analysis_id)
        return found
