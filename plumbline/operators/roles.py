"""Which physical column plays which role; read from JSON, checked once."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Any

from ..errors import ConfigError

LEAST_LOOKBACK = 90


@dataclass(frozen=True)
class ClientRoles:
    client_id: str
    age: str | None = None
    birth_date: str | None = None
    gender: str | None = None
    birth_date_format: str | None = None


@dataclass(frozen=True)
class PurchaseRoles:
    client_id: str
    transaction_id: str
    transaction_datetime: str
    amount: str
    regular_amount: str | None = None
    product_id: str | None = None
    transaction_datetime_format: str | None = None


@dataclass(frozen=True)
class ProductRoles:
    product_id: str
    category: str


@dataclass(frozen=True)
class ExperimentRoles:
    client_id: str
    treatment: str
    target: str


@dataclass(frozen=True)
class MartConfig:
    experiment_start: datetime
    clients: ClientRoles
    purchases: PurchaseRoles
    products: ProductRoles | None = None
    experiment: ExperimentRoles | None = None
    lookback_days: int = 365
    strict_referential_integrity: bool = True

    def __post_init__(self):
        if isinstance(self.lookback_days, bool) or not isinstance(self.lookback_days, int) or self.lookback_days < LEAST_LOOKBACK:
            raise ConfigError(f"lookback_days must be a whole number from {LEAST_LOOKBACK} on")
        if self.clients.age and self.clients.birth_date:
            raise ConfigError("clients have an age or a birth_date, not both")
        if self.products and not self.purchases.product_id:
            raise ConfigError("products need purchases.product_id")


def _roles(kind: type, given: Mapping[str, Any], section: str):
    fields = kind.__dataclass_fields__
    unknown = set(given) - set(fields)
    if unknown:
        raise ConfigError(f"{section}: unknown roles {sorted(unknown)}")
    for name, f in fields.items():
        value = given.get(name)
        optional = f.default is None
        if value is None and optional:
            continue
        if not isinstance(value, str) or not value.strip():
            raise ConfigError(f"{section}.{name} must name a column")
    return kind(**{k: v for k, v in given.items() if v is not None})


def config_from(value: Mapping[str, Any]) -> MartConfig:
    try:
        start = datetime.fromisoformat(value["experiment_start"])
    except (KeyError, TypeError, ValueError) as e:
        raise ConfigError("experiment_start must be an ISO date and time") from e
    sections = {}
    for name, kind, needed in (("clients", ClientRoles, True), ("purchases", PurchaseRoles, True), ("products", ProductRoles, False), ("experiment", ExperimentRoles, False)):
        given = value.get(name)
        if given is None and not needed:
            continue
        if not isinstance(given, Mapping):
            raise ConfigError(f"section {name} is missing")
        sections[name] = _roles(kind, given, name)
    more = {k: value[k] for k in ("lookback_days", "strict_referential_integrity") if k in value}
    return MartConfig(start, **sections, **more)


def load_config(path: str) -> MartConfig:
    try:
        with open(path, encoding="utf-8") as f:
            value = json.load(f)
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigError(f"can't read the mapping {path}: {e}") from e
    if not isinstance(value, Mapping):
        raise ConfigError("a mapping is a JSON object")
    return config_from(value)
