"""Operators for training-data pipelines: sharding, secrets, language-model
scoring, near duplicates, byte-level BPE, decontamination, personal data,
toxicity, embedding near duplicates, chat formatting, repeated passages,
source divergence and hard negatives.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so executors need no copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
