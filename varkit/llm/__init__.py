"""Operators of a large-scale training-data pipeline.

Thirteen operators over tables of documents, pages and embeddings: token-count rollups, a
compressed token-id file format, HTML extraction, nearest neighbours, BPE, quality rules,
source mixing, a similarity join, web archives, URL filters, ranked lexical search, toxicity
scores and an audit of filters.  Nothing else in the library imports this subpackage.  The registered queries are in ``varkit.llm.queries``.
"""

import sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers travel to the executors by value, so workers need no installed copy.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])
