"""The domain views as queries of their own."""

from __future__ import annotations

from tessera.plans.registry import query
from tessera.sources import adapters

for _name in adapters.VIEWS:
    query(f"view_{_name}", f"SELECT * FROM {_name}")(lambda t, name=_name: getattr(t, name))
