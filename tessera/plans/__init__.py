"""Query plans: each module registers its queries and their SQL."""

from tessera.plans import decision_queries  # noqa: F401
from tessera.plans import text_queries  # noqa: F401
from tessera.plans import report_queries  # noqa: F401
from tessera.plans import stream_queries  # noqa: F401
from tessera.plans import site_queries  # noqa: F401
from tessera.plans import answer_queries  # noqa: F401
from tessera.plans import work_queries  # noqa: F401
from tessera.plans import sheet_queries  # noqa: F401
from tessera.plans import fingerprint_queries  # noqa: F401
from tessera.plans import career_queries  # noqa: F401
from tessera.plans import register_queries  # noqa: F401
