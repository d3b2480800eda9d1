"""Surveillance analytics on Spark: cleaning, linkage, gap-free panels, deltas and line lists."""
