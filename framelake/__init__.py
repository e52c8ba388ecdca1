"""framelake: Spark-first analytics over media catalogs and other entity collections.

Every operator is a function from DataFrames to a DataFrame.  The package is
split into column builders (``functions``), relational operators
(``operators``), readers and writers (``sources``), plan/diff/apply
(``plans``) and incremental processing (``streaming``).
"""
