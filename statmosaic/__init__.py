"""Official-statistics panels as Spark jobs.

Everything is ``DataFrame -> DataFrame`` or a Column factory.  Codes, units,
thresholds and calendars come in as parameters; no territory is built in.
"""
