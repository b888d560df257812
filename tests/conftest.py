import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from shelfmark.runtime import local_session, ship

    s = local_session(4, 4, "4g")
    ship(s)
    return s


@pytest.fixture(scope="session")
def rows(spark):
    """A DataFrame of tuples under a DDL schema."""
    return lambda data, schema: spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def files(spark):
    """Files from partial records; what a record leaves out has a plain default."""
    from shelfmark.tables import FILES

    names = [c.split()[0] for c in FILES.split(", ")]
    plain = {"root": "/r", "size": 1, "mtime": 1, "status": "normal", "scanned_at": 1}

    def make(*records):
        full = [plain | {"id": i, "path": f"/r/f{i}.jpg"} | r for i, r in enumerate(records, 1)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], FILES)

    return make


@pytest.fixture(scope="session")
def got():
    """The rows as a sorted list of tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
