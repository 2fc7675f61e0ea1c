"""From one tenant's raw tables to validated customers, products and interactions."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfwise.config import Tenant
from shelfwise.operators import cleaning, ingest
from shelfwise.plans.roles import inputs


@dataclass(frozen=True)
class TenantTables:
    customers: DataFrame
    products: DataFrame
    interactions: DataFrame

    def violations(self) -> DataFrame:
        """Broken schema rules of all three tables."""
        parts = [cleaning.column_violations(self.customers, "customers", ["customer_id"], []),
                 cleaning.column_violations(self.products, "products", ["product_id"], []),
                 cleaning.column_violations(self.interactions, "interactions", ["customer_id", "product_id"], ["weight"])]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def counts(self) -> DataFrame:
        out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
               for name, df in (("customers", self.customers), ("products", self.products), ("interactions", self.interactions))]
        return out[0].unionByName(out[1]).unionByName(out[2])


class Adapter(ABC):
    """Extension point: a subclass says how its source becomes the three tables; run() validates them."""

    @abstractmethod
    def customers(self) -> DataFrame: ...

    @abstractmethod
    def products(self) -> DataFrame: ...

    @abstractmethod
    def interactions(self) -> DataFrame: ...

    def run(self) -> TenantTables:
        tables = TenantTables(self.customers(), self.products(), self.interactions())
        broken = tables.violations().limit(5).collect()
        if broken:
            raise ValueError("; ".join(f"{r.table_name}.{r.column_name}: {r.violation} ({r.bad_rows} rows)" for r in broken))
        return tables


class DeclaredAdapter(Adapter):
    """Tables from a declared :class:`Tenant`: a wide services table or a transaction log."""

    def __init__(self, tenant: Tenant, raw: DataFrame, customers: DataFrame | None = None, order: Sequence[Column] = ()):
        self.tenant, self.raw, self.people, self.order = tenant, raw, customers if customers is not None else raw, order

    def customers(self) -> DataFrame:
        return cleaning.build_customers(self.people, self.tenant.customer_id, self.tenant.features, self.order or [F.col(self.tenant.customer_id)])

    def products(self) -> DataFrame:
        if self.tenant.services:
            return ingest.service_products(self.raw, self.tenant.services)
        return ingest.sale_products(self.raw, self.tenant.transactions.product, self.tenant.transactions.name)

    def interactions(self) -> DataFrame:
        if self.tenant.services:
            return ingest.service_interactions(self.raw, self.tenant.customer_id, self.tenant.services)
        return ingest.sale_interactions(self.raw, self.tenant.transactions)


class StarSchemaAdapter(Adapter):
    """Example of an own adapter: customers, parts and order lines of the given star schema."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def customers(self) -> DataFrame:
        return inputs(self.spark, self.sf_dir, "shoppers")[0].select("customer_id", "c_acctbal", "c_mktsegment")

    def products(self) -> DataFrame:
        part = inputs(self.spark, self.sf_dir, "part")[0]
        return part.select(F.col("p_partkey").cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_type").alias("category"))

    def interactions(self) -> DataFrame:
        return inputs(self.spark, self.sf_dir, "bought")[0].groupBy("customer_id", "product_id").agg(F.sum("weight").alias("weight"))
