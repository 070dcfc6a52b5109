"""cartlake: e-commerce lake analytics written as plain PySpark jobs."""

from cartlake.config import LakeConfig, TableLayout
from cartlake.schemas import Tables

__all__ = ["LakeConfig", "TableLayout", "Tables"]
