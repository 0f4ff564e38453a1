"""Registered queries: operators over the driver tables, and the SQL that checks them."""
