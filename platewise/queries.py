"""Registry of the screening queries: importing the jobs registers them."""

from __future__ import annotations

from platewise.jobs import events, graphs, inference, kernels, models, modes, objects, paths, screens, selections, soft, tracking, tracks  # noqa: F401
from platewise.model import ORACLES, QUERIES  # noqa: F401
