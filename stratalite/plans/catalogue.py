"""All queries of the library over the driver tables."""

from . import catalogs, fields, formats, gridding, grids, imagery, joins, models, reports, scalars, shapes, statistics, streams, structures  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
