"""The engine's queries over the given tables, with SQL to check them against."""
