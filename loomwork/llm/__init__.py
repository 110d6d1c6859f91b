"""Operators of a training-data pipeline: decontamination, de-duplication, packing and more.

Nothing else in the library imports this subpackage.
"""
