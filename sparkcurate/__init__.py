"""sparkcurate: text-record curation and model evaluation as Spark DataFrame jobs."""

from sparkcurate.session import build_session, cut_lineage, shared_dir

__all__ = ["build_session", "cut_lineage", "shared_dir"]
__version__ = "0.1.0"
