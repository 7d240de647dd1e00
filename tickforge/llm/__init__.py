"""Training-data pipeline operators.

Each module holds one operator with a general DataFrame interface; ``queries``
registers the thin ``opN_<name>`` queries over whole tables. Nothing else in
the library imports this package.
"""
