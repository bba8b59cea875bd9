"""A document-graph context engine on Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Gives the package's modules to Python workers, once per application (they may lack the driver's path)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here, to = Path(__file__).resolve().parent, tempfile.mkdtemp(prefix="lexweave-py-")
    with zipfile.ZipFile(os.path.join(to, "lexweave.zip"), "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(os.path.join(to, "lexweave.zip"))
