"""ricefield: seasonal farm-production analytics as Spark DataFrame plans.

Tables (one per entity, ``season`` column, partitioned by season):
municipality, association, variety, farmer.  See ``ricefield.sources.model``.
"""

__version__ = "0.1.0"
