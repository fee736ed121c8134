"""Column expressions: element types, IEEE-safe math and the table of element-wise functions."""
