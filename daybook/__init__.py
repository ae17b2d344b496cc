"""daybook: customer-lifecycle analytics as Spark DataFrame jobs.

Every public function takes DataFrames (plus a :class:`~daybook.params.Params`)
and returns a DataFrame; nothing is collected to the driver.
"""

from daybook.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"
