"""Operators that prepare training data. Optional: no other module of the package imports this one."""
