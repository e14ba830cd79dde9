"""spindrift: source-reliance analytics and corpus operators on PySpark."""
