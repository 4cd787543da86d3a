"""Column-expression helpers (all JVM-side, codegen friendly)."""

from routewise.functions.exprs import *  # noqa: F401,F403
