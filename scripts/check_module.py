"""Compare every query of one plans module: check_module.py MODULE [sf_dir]."""

import importlib
import sys

import check_oracles as c

mod = importlib.import_module(f"tidemark.plans.{sys.argv[1]}")
sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
spark, con = c.local_session(), c.connect(sf)
for n in mod.QUERIES:
    try:
        text, ts, td, _ = c.compare(spark, con, n, sf)
    except Exception as exc:  # noqa: BLE001
        text, ts, td = f"ERROR {str(exc)[:900]}", 0.0, 0.0
    print(f"{n:36s} {ts:6.2f} {td:6.2f} {text[:1200]}", flush=True)
