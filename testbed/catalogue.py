"""All registered queries: importing the modules fills the registry."""

from testbed import (queries_audits, queries_catalogue, queries_identity, queries_live, queries_plans, queries_reader,  # noqa: F401
                     queries_recommend, queries_scalar, queries_series, queries_sources)
from testbed.registry import QUERIES, oracles  # noqa: F401
