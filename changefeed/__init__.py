"""Change-data processing on Spark: decode, check, route and replay row-level change logs.

Every public function takes and returns DataFrames (or Columns), keeps no session and runs no
action unless its name says so (``write_*``, ``save_*``, ``start_*``).
"""

__version__ = "1.0.0"
