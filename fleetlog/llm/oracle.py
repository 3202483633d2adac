"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from fleetlog.llm.decontaminate import OP7_SQL
from fleetlog.llm.secret_scan import OP6_SQL
from fleetlog.llm.shallot import OP11_SQL
from fleetlog.llm.sharding import OP5_SQL
from fleetlog.llm.sigtree import OP12_SQL

ORACLE: dict[str, str] = {
    "op5_sharding": OP5_SQL,
    "op6_secrets": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_clusters": OP11_SQL,
    "op12_jaccard": OP12_SQL,
}
