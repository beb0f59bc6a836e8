"""Scans: line files, JSON and CloudTrail documents, Windows event XML, Zeek logs."""
