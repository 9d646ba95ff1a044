"""Column -> Column helpers shared by all operators (JVM-side built-ins only)."""

from marketlens.functions.columns import *  # noqa: F401,F403
