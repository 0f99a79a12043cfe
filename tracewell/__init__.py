"""DNS behaviour analytics on Spark: events to windows, rules, suspicious domains, correlation and reports."""
