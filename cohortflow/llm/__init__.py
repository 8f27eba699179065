"""Training-data operators: one module per operator, `entry` lists their queries and SQL."""
