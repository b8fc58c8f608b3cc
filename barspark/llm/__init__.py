"""Operators for preparing large text corpora; nothing else in the package imports this one.

Each module holds one operator with its own general interface; ``queries`` derives the registered
``opN_`` queries from them. Shared rules:

* texts, lists and tables may be null, empty or very long; every operator states its result;
* intermediate tables are written under the session's shared folder (``common.cut``), so a lost
  executor costs a re-read and never a wrong answer;
* columns the operators add win over input columns of the same name.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
