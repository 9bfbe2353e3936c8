"""maternis: maternal-mortality marts and reports on Spark."""
