"""Fleet-telemetry analytics as PySpark DataFrame operators.

``operators`` holds the batch work (clean, query, rules, detect, lifecycle, notify, agents,
credentials, maintain), ``sources`` the readers and sinks, ``functions`` the column helpers,
``streaming`` the Structured Streaming jobs and ``plans`` the registered queries with their
checking SQL.  Sessions are expected to run in UTC.
"""
