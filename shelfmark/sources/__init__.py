"""Readers of the engine: strict text formats, journals, inventories and containers."""
