"""Every query that the driver can run, and its SQL."""

from __future__ import annotations

from . import by_source as _by_source  # noqa: F401  (registers its queries)
from . import feeds as _feeds  # noqa: F401
from . import labelled as _labelled  # noqa: F401  (registers its queries)
from . import layouts as _layouts  # noqa: F401
from . import more as _more  # noqa: F401
from . import people as _people  # noqa: F401
from . import profiles as _profiles  # noqa: F401
from . import resumes as _resumes  # noqa: F401
from . import search as _search  # noqa: F401
from . import tables as _tables  # noqa: F401
from . import wishes as _wishes  # noqa: F401
from .queries import ORACLE_SQL, QUERIES

FLAGSHIP = "usage_overview"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
