"""Operators for large training-data pipelines: personal data, scoring, copies, licences, mixing,
quality rules, sharding, decontamination, toxicity and secrets.

Nothing else in the library imports this package. Every operator reads whole texts of all rows.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
