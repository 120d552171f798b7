"""driftline: event-study, time-series and corpus operators as Spark DataFrame transformations."""
