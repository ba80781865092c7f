"""Survey-panel data processing as PySpark DataFrame and Column operations."""
