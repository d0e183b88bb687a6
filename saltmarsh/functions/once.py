"""Values that are computed once for a long expression over them."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once and bound to a name, null included.

    A projection that holds such a binding is generated as many short methods. Long chains of searches or patterns fused into a
    stage's one loop make a method too large for the JVM to compile, which it then interprets.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
