"""Operators for preparing training corpora, one module each.

Nothing else in the package imports this folder. Common rules of all operators:
input columns are taken by name, extra columns travel along untouched, and a
result column replaces an input column of the same name. Rows are told apart by
their id and the hash of their text, so repeated rows get equal results.
"""

import plantmon
from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so the workers need no
# copy of this package on their path.
cloudpickle.register_pickle_by_value(plantmon)
