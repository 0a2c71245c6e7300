"""Column-level helpers; everything here returns a Column."""
