"""Column builders: each takes Columns and returns a Column; no state, no Python at run time."""
