"""Tables in the shared folder."""

import os

from folioscope import storage


def test_stored_tables_are_their_data_files_alone(spark):
    out = storage.stored(spark.range(0, 100, 1, 3))
    assert sorted(r.id for r in out.collect()) == list(range(100))
    for folder in {os.path.dirname(f.removeprefix("file://").replace("//", "/")) for f in out.inputFiles()}:
        assert all(x.startswith("part-") for x in os.listdir(folder))
