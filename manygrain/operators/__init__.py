from .expand import expand_with_margins
from .inspection import inspect_grouping
from .nest import nest_by_with_margins, nest_with_margins
from .summarize import summarise_with_margins, summarize_with_margins

__all__ = ["expand_with_margins", "inspect_grouping", "nest_by_with_margins", "nest_with_margins", "summarise_with_margins", "summarize_with_margins"]
