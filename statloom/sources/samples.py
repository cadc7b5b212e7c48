"""Small demonstration data, generated by formula."""

from __future__ import annotations

import csv
import math
import random
import sqlite3
from pathlib import Path


def write_samples(folder: str, seed: int = 7) -> dict[str, str]:
    """sales.csv (1080 rows), wafer.csv (six wafers) and fab.db (tools, measurements)."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    rng = random.Random(seed)
    paths = {n: str(base / f) for n, f in (("sales", "sales.csv"), ("wafer", "wafer.csv"), ("fab", "fab.db"))}
    with open(paths["sales"], "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["date", "region", "product", "units", "unit_price"])
        for day in range(90):
            for region in ("North", "South", "East", "West"):
                for k, product in enumerate(("Basic", "Plus", "Pro")):
                    out.writerow([f"2026-{day // 30 + 1:02d}-{day % 30 + 1:02d}", region, product, rng.randint(5, 60), 1200 * (k + 1)])
    with open(paths["wafer"], "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["wafer_id", "die_x", "die_y", "yield"])
        for w in range(6):
            for x in range(-11, 12):
                for y in range(-11, 12):
                    r = math.hypot(x, y)
                    if r <= 11.5:
                        loss = (0, 2.5 * max(0, r - 8), 25 * math.exp(-((x - 4) ** 2 + (y - 4) ** 2) / 8), 15 * (x + y == 0), 3 * max(0, 5 - r), 1.2 * abs(x))[w]
                        out.writerow([f"W{w + 1:02d}", x, y, round(min(100.0, max(0.0, 96 - loss + rng.gauss(0, 1.5))), 2)])
    Path(paths["fab"]).unlink(missing_ok=True)
    with sqlite3.connect(paths["fab"]) as con:
        con.execute("create table tools (tool_id text primary key, tool_type text, install_year integer)")
        con.executemany("insert into tools values (?, ?, ?)", [(f"T{i}", ("etch", "litho", "cmp")[i % 3], 2015 + i) for i in range(1, 6)])
        con.execute("create table measurements (lot_id text, tool_id text, step integer, yield real, defects integer)")
        con.executemany("insert into measurements values (?, ?, ?, ?, ?)", [(f"LOT{i:04d}", f"T{i % 5 + 1}", i % 4 + 1, round(93 - 4 * (i % 5 == 2) + rng.gauss(0, 1), 2), rng.randint(0, 12)) for i in range(1, 201)])
    return paths
