"""Operators bound to the supplied tables, and the SQL that checks them."""
