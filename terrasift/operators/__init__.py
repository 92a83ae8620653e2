"""Operators on tables of cells: a raster is a table (r, c, ...), a mask is a table (r, c) of its true cells."""
