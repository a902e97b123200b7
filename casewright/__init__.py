"""Complaint-forensics analytics on Spark."""
