"""Where collections come from and go to."""

from papyra.sources.json_files import read_json, write_json
from papyra.sources.store import Conflict, Store

__all__ = ["Conflict", "Store", "read_json", "write_json"]
