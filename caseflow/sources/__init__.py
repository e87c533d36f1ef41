"""Table schemas and loaders."""

from caseflow.sources.loader import conform, load_tables
from caseflow.sources.landing import land_history, land_requests, landed
from caseflow.sources.schemas import COLUMN_ALIASES, registry, table_names
from caseflow.sources.spellings import label_spellings

__all__ = ["COLUMN_ALIASES", "conform", "label_spellings", "land_history", "land_requests",
           "landed", "load_tables", "registry", "table_names"]
