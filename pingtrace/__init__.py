"""Contact, exposure and sampling operators for location-ping tables on Spark."""
