"""Operations analytics on Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); no session, path or table name is hidden inside.
"""
