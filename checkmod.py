"""check.py for whole catalogue modules: checkmod.py module ..."""
import sys

import check
from oosgauge.catalog import load
from oosgauge.catalog.base import QUERIES

load()
mods = sys.argv[1:]
sys.argv = ["check.py"] + [n for n, f in QUERIES.items() if f.__module__.split(".")[-1] in mods]
check.main()
