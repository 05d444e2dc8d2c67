"""quarrymill: a Spark-native engine for weighted full-text indexes and the
data preparation around them.

The core (``functions``, ``operators``, ``sources``, ``plans``, ``streaming``)
builds, stores and queries inverted indexes.  The optional subpackage ``llm``
holds operators for training data; nothing in the core imports it.
"""

__version__ = "0.1.0"
