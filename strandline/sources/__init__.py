"""Inputs: fact tables, workspace listings, source files and the recent list."""
