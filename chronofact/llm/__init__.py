"""Training-data operators: sharding, cleaning, joins, selection and tokenizing.

Nothing else in the library imports this subpackage.
"""
