"""All registered queries: importing this module fills the catalog."""

from pvlens.plans import q_analysis, q_annotation, q_profile, q_training  # noqa: F401
from pvlens.plans import q_io, q_more  # noqa: F401  (reuse oracles registered above)
from pvlens.plans.catalog import ORACLES, QUERIES  # noqa: F401
