"""Declared shape of one tenant's data: frozen driver-side settings that compile to columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Feature:
    """One declared customer or product feature."""

    name: str
    dtype: str = "numeric"  # numeric | categorical
    allowed: tuple[str, ...] = ()
    encoding: str = "passthrough"  # passthrough | one_hot

    def __post_init__(self):
        if self.dtype not in ("numeric", "categorical"):
            raise ValueError(f"feature {self.name}: unknown dtype {self.dtype}")
        if self.encoding not in ("passthrough", "one_hot"):
            raise ValueError(f"feature {self.name}: unknown encoding {self.encoding}")


@dataclass(frozen=True)
class ServiceColumns:
    """Wide yes/no columns plus at most a few multi-valued columns."""

    flags: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ("No",)
    null_is_positive: bool = True
    # (column, value) -> product id
    multi_value: Mapping[tuple[str, str], str] = field(default_factory=dict)


@dataclass(frozen=True)
class TransactionColumns:
    customer: str
    product: str
    quantity: str | None = None
    invoice: str | None = None
    name: str | None = None
    cancel_prefixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Segmentation:
    field: str
    split: str = "median"  # median | categorical
    threshold: float | None = None
    category_value: str | None = None
    lower_label: str = "newer"
    upper_label: str = "established"


@dataclass(frozen=True)
class Tenant:
    tenant_id: str
    customer_id: str
    features: tuple[Feature, ...] = ()
    transactions: TransactionColumns | None = None
    services: ServiceColumns | None = None
    segmentation: Segmentation | None = None

    def __post_init__(self):
        if (self.transactions is None) == (self.services is None):
            raise ValueError("declare exactly one of transactions and services")


def tenant_from_dict(tenant_id: str, raw: Mapping) -> Tenant:
    """Parse a configuration mapping (for example one loaded from YAML)."""
    customers = raw.get("customers") or {}
    features = tuple(
        Feature(f["name"], f.get("dtype", "numeric"), tuple(str(v) for v in f.get("allowed_values") or ()),
                f.get("encoding", "passthrough"))
        for f in customers.get("features") or ()
    )
    source = raw.get("interactions") or {}
    prefixes: str | Sequence[str] = source.get("exclude_invoice_prefix") or ()
    if isinstance(prefixes, str):
        prefixes = (prefixes,)
    transactions = services = None
    if source.get("source") == "transactional":
        transactions = TransactionColumns(
            customer=source["customer_id_column"], product=source["product_id_column"],
            quantity=source.get("quantity_column"), invoice=source.get("transaction_id_column"),
            name=source.get("product_name_column"), cancel_prefixes=tuple(prefixes),
        )
    else:
        services = ServiceColumns(tuple(source.get("service_columns") or ()),
                                  tuple(source.get("negative_values") or ("No",)))
    seg = raw.get("segmentation")
    return Tenant(tenant_id, customers["id_column"], features, transactions, services,
                  Segmentation(**seg) if seg else None)
