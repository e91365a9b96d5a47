"""Operators for preparing training text at corpus scale.

Every operator takes DataFrames and column names and returns a DataFrame. Nothing outside this
package imports it.
"""
