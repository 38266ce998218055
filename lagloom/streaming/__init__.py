"""No operator of the method is a stream: there is no watermark, window or state in it.

New periods arrive through the incremental batch upsert in ``lagloom.plans.refresh``.
"""
