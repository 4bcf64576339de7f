"""Search and summarise log tables with Spark DataFrames.

Every public function takes DataFrames or Columns and returns a lazy DataFrame
or Column; Catalyst plans the work. See README.md for the operator list.
"""
