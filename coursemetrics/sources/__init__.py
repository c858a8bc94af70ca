from coursemetrics.sources.tables import read_table, DRIVER_TABLES
from coursemetrics.sources.binding import (silver_from_events, dim_courses_from_part,
                                           dim_learners_from_customer, Binding)

__all__ = ["read_table", "DRIVER_TABLES", "silver_from_events", "dim_courses_from_part",
           "dim_learners_from_customer", "Binding"]
