"""Logical plans: the query catalogue and the lowering of formulas to DataFrames."""
