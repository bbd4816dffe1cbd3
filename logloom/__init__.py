"""Incident analytics over service logs with Spark: windows, anomalies, alerts, incidents and root causes."""
