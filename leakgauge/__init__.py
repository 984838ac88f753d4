"""leakgauge: Spark-native audit of identifier leakage over tables of any size.

The core package never imports ``leakgauge.llm``; that subpackage holds the
training-data operators and can be removed without touching anything else.
"""

__version__ = "0.1.0"
