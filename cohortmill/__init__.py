"""Cohort analytics over pooled clinical-study tables, written on Spark DataFrames.

Every operator takes DataFrames or Columns and returns DataFrames or Columns; the
package starts no session and keeps no state of its own.
"""
