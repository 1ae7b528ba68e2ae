"""Operators for large text corpora: deduplication, filtering, mixing, sharding.

Every module holds one operator that takes and returns DataFrames.  Nothing else in the
package imports this subpackage.
"""
