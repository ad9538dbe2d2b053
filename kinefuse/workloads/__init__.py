"""Every operator as a query over the benchmark tables, next to the SQL that checks it.

The tables hold no traffic data, so each query first lets them stand in for sensors, files, sources
or roads (`standins`). A query without SQL has no SQL form; tests check it against fixtures.
"""

from kinefuse.workloads import changes, extraction, folders, measures, places, responses, roads, values
from kinefuse.workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "changes", "extraction", "folders", "measures", "places", "responses", "roads", "values"]
