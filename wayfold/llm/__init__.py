"""Operators for preparing language-model training data at scale.

Every module works on plain DataFrames.  Common rules: a null text counts as
an empty one unless the docstring says otherwise, whole texts are used, input
columns that an operator doesn't need are ignored, and a new column replaces an
input column of the same name (compared without case).
"""
