"""Column builders; every function takes and returns Spark columns and stays inside codegen."""
