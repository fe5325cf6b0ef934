"""Binary-outcome risk analytics over account tables, as Spark DataFrame operators."""
