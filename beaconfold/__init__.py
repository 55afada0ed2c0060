"""Analytics over fleets of devices with credential profiles, on PySpark.

Lifecycle events are folded into a keyed registry, routed to subscribers,
measured and rolled up, in batch and as streams.
"""
