"""Reports at several levels of detail at once, on PySpark."""

from .errors import MarginError
from .functions import across, grouping_bit, grouping_id, if_all, if_any, pick, share_across, share_of_parent, share_of_total
from .operators import (
    expand_with_margins,
    inspect_grouping,
    nest_by_with_margins,
    nest_with_margins,
    summarise_with_margins,
    summarize_with_margins,
)
from .plans.labels import NA, categorical, is_na_level
from .plans.spec import (
    all_of,
    any_of,
    between,
    contains,
    cube,
    ends_with,
    everything,
    grouping_set,
    grouping_sets,
    grouping_spec,
    matches,
    rollup,
    starts_with,
    where,
)
from .sources import retail_sales

__all__ = [
    "NA", "MarginError", "across", "all_of", "any_of", "between", "categorical", "contains", "cube", "ends_with", "everything", "expand_with_margins",
    "grouping_bit", "grouping_id", "grouping_set", "grouping_sets", "grouping_spec", "if_all", "if_any", "inspect_grouping", "is_na_level", "matches", "nest_by_with_margins", "nest_with_margins",
    "pick", "retail_sales", "rollup", "share_across", "share_of_parent", "share_of_total", "starts_with", "summarise_with_margins", "summarize_with_margins", "where",
]
