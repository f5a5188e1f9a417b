"""grainwise: order, delivery and review analytics as ordinary Spark jobs.

Layers, lowest first:

* ``functions``  column expressions (delivery measures, labels, rounding)
* ``operators``  DataFrame-in, DataFrame-out building blocks
* ``sources``    readers, writers and the adapter for the benchmark tables
* ``plans``      marts, metrics, report datasets and reconciliation
"""

__version__ = "0.1.0"
