"""DataFrame-to-DataFrame operators.

Conventions: inputs are count cells (integer/string keys plus a double measure),
operators are lazy, and none of them hints a broadcast: small sides are chosen
by Spark from their measured size.  Windows are only opened over count cells,
where a partition holds at most one row per category.
"""
