"""Column functions: no rows are moved by anything in here."""
