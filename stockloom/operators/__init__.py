"""Grouping, joining, ordering and encoding steps the plans are made of."""
