"""Security and hygiene audits over many source repositories, as Spark jobs."""

import sys

from pyspark import cloudpickle

from auditlake.options import CustomRule, ScanOptions, Suppression
from auditlake.plans.scan import ScanResult, scan

# Functions that run in executors' Python workers travel by value: a cluster needs no copy of the package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CustomRule", "ScanOptions", "ScanResult", "Suppression", "scan"]
__version__ = "0.1.0"
