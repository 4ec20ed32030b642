"""Physical-plan helpers shared by the operators: size-checked joins and lineage cuts."""

from rowtrail.plans.joins import fits, join_small, salted_join
from rowtrail.plans.lineage import cut, scratch

__all__ = ["cut", "fits", "join_small", "salted_join", "scratch"]
