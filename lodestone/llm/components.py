"""Connected components of an edge table; they live outside, as entity resolution uses them too."""

from __future__ import annotations

from ..components import components  # noqa: F401
