"""folio: a Spark-native engine for passage retrieval, its evaluation, and corpus preparation.

Operators are functions from DataFrames to DataFrames (or Columns to Columns). They declare
plans and leave physical strategy to Catalyst; the few that must cut lineage do so through
``folio.session.materialize``, which writes to the shared checkpoint folder.
"""
