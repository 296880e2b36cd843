"""Training-data operators: licence scan, decontamination, quality, mixing,
chat formatting, deduplication, language identification, language modelling.

Nothing else in the library imports this subpackage.
"""
