"""Worlds, grids, parameters, graphs: what is decided on the driver before any DataFrame runs."""
