"""Lake configuration: logical tables, their physical names and their source files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

# The logical tables, and below the sections and keys of a settings file.
LOGICAL_TABLES = ("customers", "products", "orders", "order_items", "product_reviews")


@dataclass(frozen=True)
class TableLayout:
    """How a table is laid out on storage; the Spark stand-in for secondary indexes.

    ``partition_by`` gives partition pruning, ``sort_by`` gives tight Parquet
    row-group statistics, ``bucket_by`` lets two tables join without a shuffle.
    Hot keys are written by several tasks; join tables that have some with
    ``operators.skew.bucketed_join``, as a bucket is one task in a plain join.
    """

    partition_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    bucket_by: str | None = None
    buckets: int = 0


@dataclass(frozen=True)
class LakeConfig:
    """Where the lake's files and tables are.

    A table with an entry in ``schemas`` is read in these types, without opening the footers of all its files.
    """

    archive_path: str
    warehouse_path: str
    database: str = "ecommerce"
    tables: Mapping[str, str] = field(default_factory=lambda: {t: t for t in LOGICAL_TABLES})
    files: Mapping[str, str] = field(default_factory=lambda: {t: f"{t}.parquet" for t in LOGICAL_TABLES})
    layouts: Mapping[str, TableLayout] = field(default_factory=dict)
    schemas: Mapping[str, StructType] = field(default_factory=dict)
    top_countries_limit: int = 10

    @classmethod
    def from_mapping(cls, settings: Mapping) -> LakeConfig:
        """Build from the nested sections of a settings file (already parsed)."""
        return cls(
            archive_path=settings["parquet_files"]["base_path"],
            warehouse_path=settings["database"]["data_path"],
            database=settings["database"].get("name", "ecommerce"),
            tables=dict(settings["tables"]),
            files=dict(settings["parquet_files"]["files"]),
            top_countries_limit=settings["analytics"]["top_countries_limit"],
        )

    def file_path(self, logical: str) -> str:
        return f"{self.archive_path.rstrip('/')}/{self.files[logical]}"

    def table_path(self, logical: str) -> str:
        return f"{self.warehouse_path.rstrip('/')}/{self.tables[logical]}"

    def qualified(self, logical: str) -> str:
        return f"`{self.database}`.`{self.tables[logical]}`"
