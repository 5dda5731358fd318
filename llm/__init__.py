"""Operators for preparing training data at corpus scale.

Nothing outside this folder imports it; `__spark_entry__.py` adds its queries
only when the folder is present.
"""
