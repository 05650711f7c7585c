"""All registered queries, imported so each module registers its own.

Each one runs a library operator over whole test tables through the bindings.
"""

from larder.plans.registry import REGISTRY, money_out, register  # noqa: F401
from larder.plans import q_catalog, q_orders, q_lists, q_customers, q_reports, q_changes, q_streams  # noqa: E402,F401
