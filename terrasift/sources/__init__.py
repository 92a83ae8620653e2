"""Readers that turn tables into cells, sites and polylines."""
