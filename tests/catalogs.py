"""A small made-up catalog: images, spectra and scalars in three partitions."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tessera.functions import properties
from tessera.functions.layout import Partition

#: The driver's smallest tables.
DATA = Path("/root/testdata/sf0.001")
#: Rows of each partition; in each the second row has no image and the first no flux.
PARTS = {Partition(4, 119): 10, Partition(5, 1239): 7, Partition(6, 15000): 5}
PROPERTIES = {"obs_collection": "test_legacysurvey_desi", "hats_nrows": 22, "hats_order": 6, "hats_skymap_order": 8, "hats_estsize": 1}
FLOATS = pa.list_(pa.float32())
IMAGE = pa.struct({"band": pa.list_(pa.string()), "flux": pa.list_(pa.list_(FLOATS))})
SPECTRUM = pa.struct({"flux": FLOATS, "ivar": FLOATS, "lambda": FLOATS, "mask": pa.list_(pa.bool_())})
SCHEMA = pa.schema({"_healpix_29": pa.int64(), "object_id": pa.string(), "ebv": pa.float32(), "flux_g": pa.float32(), "z_spec": pa.float32(), "image": IMAGE, "spectrum": SPECTRUM})


def row(place: int, i: int, band: str) -> dict:
    """Smooth values from the place alone, so that a row is known anywhere."""
    y, x = np.mgrid[0:97, 0:98]
    image = {"band": ["des-g", "des-r", band], "flux": [np.sin(x * (b + 1) / 9 + y / 7 + i).tolist() for b in range(3)]}
    wave = np.geomspace(3700, 9100, 24)
    spectrum = {"flux": np.cos(wave / 500 + i).tolist(), "ivar": [1.5] * 24, "lambda": wave.tolist(), "mask": [i == 3] * 24}
    return {"_healpix_29": (place << 40) + i, "object_id": f"o{place}_{i}", "ebv": i / 100, "flux_g": None if i == 0 else 1 + i / 8, "z_spec": i / 20, "image": None if i == 1 else image, "spectrum": spectrum}


def make(root: Path, bad: Partition | None = None) -> Path:
    """Write the catalog without its index; bad: a partition whose images have an unknown band."""
    for place, (p, n) in enumerate(PARTS.items()):
        path = root / "dataset" / p.file
        path.parent.mkdir(parents=True)
        table = pa.Table.from_pylist([row(place, i, "mystery-q" if p == bad else "des-z") for i in range(n)], SCHEMA)
        pq.write_table(table, path, row_group_size=4)
    (root / "hats.properties").write_text(properties.write(PROPERTIES, "HATS catalog"))
    return root
