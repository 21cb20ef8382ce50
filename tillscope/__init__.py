"""Item-level retail sales analytics on Spark.

Every public function takes DataFrames and returns DataFrames; nothing here
collects rows to the driver.  The sub-packages are

``sources``    readers, writers and named tables
``functions``  column expressions (headers, parsing, calendar, numbers)
``operators``  reusable DataFrame operators (cleaning, contract, numbering, ...)
``plans``      the three sales tables and the reports over them
``catalog``    the registered queries and their SQL counterparts
"""
