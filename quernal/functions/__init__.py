"""All 240 built-in functions; importing this package registers them."""

from quernal.functions import bools, chars, floats, integers, oids, varchars  # noqa: F401
