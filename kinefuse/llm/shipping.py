"""Python workers need this package too; see `kinefuse.shipping`."""

from kinefuse.shipping import ship

__all__ = ["ship"]
