"""attesta: a PySpark engine for versioned document evidence."""
