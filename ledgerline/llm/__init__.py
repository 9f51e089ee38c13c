"""Operators for preparing training data.

Nothing else in the package imports this subpackage; it can be deleted and the
rest keeps working.  One module per operator, ``queries`` holds the registered
queries and their SQL.

Conventions shared by all operators
-----------------------------------
* Only the identifier, text and grouping columns named in the arguments are
  read, under private names, so extra or clashing input columns do no harm.
* A null text is an empty text.  A null identifier is kept as a null
  identifier and sorts after all others.
* Repeated rows are separate rows: each gets a private row number
  (``rows.with_row_id``) and its own output row.
* Intermediate tables that are read more than once are written as Parquet
  below ``spark.checkpoint.dir`` (``rows.materialize``).
"""
