"""All registered queries; importing the modules fills the registry."""

from . import logs_net, detection, enrich, cases, intake, measure  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
