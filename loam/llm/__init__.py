"""Training-data operators: thirteen of them and the helpers they share.

Nothing outside this subpackage imports it.
"""
