"""Operators for cleaning, linking, splitting, encoding and mixing training text.

The rest of the package never imports this subpackage.
"""
