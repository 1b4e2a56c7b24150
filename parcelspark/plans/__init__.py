"""Products: each a function of tables and an as-of date."""
