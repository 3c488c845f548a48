"""All registered queries and their SQL, without the corpus operators."""

from grainmill.plans import admission as _admission  # noqa: F401  these add their queries to the catalogue
from grainmill.plans import details as _details  # noqa: F401
from grainmill.plans import grading as _grading  # noqa: F401
from grainmill.plans import measures as _measures  # noqa: F401
from grainmill.plans import reconcile as _reconcile  # noqa: F401
from grainmill.plans import scene as _scene  # noqa: F401
from grainmill.plans.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
