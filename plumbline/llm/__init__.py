"""Training-data preparation: ten corpus operators and the queries that apply them.

Nothing outside this subpackage imports it; it can be deleted without
breaking the rest of the library.
"""
