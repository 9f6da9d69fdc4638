"""Segloom: labelled-interval analytics on PySpark."""
