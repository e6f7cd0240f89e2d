"""A retail real-time warehouse expressed as Spark DataFrame jobs.

Layers: raw logs and change records (ODS) -> cleaned and routed facts and
dimensions (DWD) -> widened orders, visits and bounces (DWM) -> ten-second
statistics (DWS) -> dashboard queries (ADS).  Operators are
``DataFrame -> DataFrame`` functions that work on batch and streaming frames
alike; operators that keep keyed state have a batch twin and a streaming form.
"""
