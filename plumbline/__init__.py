"""plumbline: trustworthy people-analytics operators as Spark DataFrame jobs.

Every operator takes DataFrames plus column names and returns a DataFrame built
from Column expressions and DataFrame transforms, so Catalyst plans, prunes and
pushes down the work. Nothing is collected to the driver except parameters.
"""

__version__ = "0.1.0"
