"""Training-data operators: language id, chat rendering, packing, de-duplication, search and archives.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries and the SQL that the entry module adds when the subpackage is present.
"""
