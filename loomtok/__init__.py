"""Spark-native sub-word tokenization: train vocabularies and encode corpora with DataFrames.

Functions that run on executors are pickled by value, so that these need no copy of the package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.3.2"

cloudpickle.register_pickle_by_value(sys.modules[__name__])

from loomtok.plans.config import TokenizeArgs, TrainConfig, TrainerKind  # noqa: E402
from loomtok.plans.dataset import tokenize  # noqa: E402
from loomtok.plans.tokenizer import Tokenizer  # noqa: E402
from loomtok.plans.training import train  # noqa: E402

__all__ = ["TokenizeArgs", "Tokenizer", "TrainConfig", "TrainerKind", "__version__", "tokenize", "train"]
