"""Registered queries over the derived inputs, and the SQL they are checked against."""
