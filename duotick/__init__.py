"""Table operators on two clocks, and corpus operators, for PySpark."""
