"""Training-data operators: extraction, filtering, de-duplication, formatting, mixing.

Nothing else in the package imports this subpackage; ``queries.py`` holds the
registered ``opN_*`` queries and their SQL twins.
"""
