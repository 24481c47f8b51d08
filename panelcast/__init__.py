"""panelcast: panel time-series preparation and forecasting on Spark DataFrames.

Every operator takes a DataFrame plus a :class:`~panelcast.plans.panel.Panel`
description (series keys, time column, step index, segment column) and returns a
DataFrame.  All series are processed in one pass; ordering is always explicit.
"""

from panelcast.plans.panel import Panel

__all__ = ["Panel"]
__version__ = "0.1.0"
