"""Importing this module fills the catalog of the subpackage."""

from pvlens.llm import alignment, bpe, conversations, decontamination, fingerprint, pii, quality, repeats, secret_scan, sharding, simhash, token_counts, token_files  # noqa: F401
from pvlens.llm.catalog import ORACLES, QUERIES  # noqa: F401
