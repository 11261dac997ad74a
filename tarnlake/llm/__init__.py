"""Training-data operators: each module is one operator with a general interface.

Nothing else in the package imports this subpackage; ``queries`` holds the thin queries over it.
"""
