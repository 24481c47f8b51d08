"""Readers and writers: driver tables, panels derived from them, CSV feature/label files, forecast outputs."""

from panelcast.sources.tables import read_table
from panelcast.sources.panels import events_panel, orders_panel, orders_weekly

__all__ = ["read_table", "orders_panel", "orders_weekly", "events_panel"]
