from .context import Deferred, grouping_bit, grouping_id
from .selections import Across, Selected, ShareAcross, across, if_all, if_any, pick, share_across
from .shares import Share, share_of_parent, share_of_total

__all__ = ["Across", "Deferred", "Selected", "Share", "ShareAcross", "across", "grouping_bit", "grouping_id", "if_all", "if_any", "pick", "share_across", "share_of_parent", "share_of_total"]
