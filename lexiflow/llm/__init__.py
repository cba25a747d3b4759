"""Training-data pipeline operators (packing, language ID, dedup, mixing, ...).

Each module holds one operator as a function ``DataFrame -> DataFrame``; ``queries``
registers one query per operator. Nothing else in the library imports this package.
"""
