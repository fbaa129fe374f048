"""Spanning forests, components and edge-list analytics of weighted graphs held as DataFrames."""
