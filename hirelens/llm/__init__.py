"""Operators that prepare texts, vectors and pages as training data.

Rules that hold for all of them: only the columns named in a docstring are
read, so extra columns with any names do no harm; a null text counts as empty;
a null id counts as the largest one where ids are compared.
"""
