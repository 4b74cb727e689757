"""bookloom: catalogue matching, repair and recommendation as Spark jobs.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing here starts a session, collects rows or keeps global state.
"""
