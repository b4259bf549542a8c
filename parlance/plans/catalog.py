"""All registered queries (importing the modules fills the registry).

Order matters: later modules compose the oracle SQL of earlier ones.
"""

from __future__ import annotations

from . import q_lexical  # noqa: F401  isort: skip
from . import q_features  # noqa: F401  isort: skip
from . import q_psych  # noqa: F401  isort: skip
from . import q_similarity  # noqa: F401  isort: skip
from . import q_timing  # noqa: F401  isort: skip
from . import q_assemble  # noqa: F401  isort: skip
from . import q_evaluate  # noqa: F401  isort: skip
from . import q_adapt  # noqa: F401  isort: skip
from . import q_trees  # noqa: F401  isort: skip
from . import q_sources  # noqa: F401  isort: skip
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
