"""kinefuse: fusing traffic-sensor files with a road network as Spark jobs."""

__version__ = "0.1.0"
