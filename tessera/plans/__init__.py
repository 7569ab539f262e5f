"""Registered queries: operators bound to the test tables, with the SQL that checks them."""
