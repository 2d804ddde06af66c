"""Tables in the folder that all executors share, which cut lineage: those of the library."""

from quillframe.sources.tables import folder, made, table

__all__ = ["folder", "made", "table"]
