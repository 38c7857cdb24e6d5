"""One local session for all tests; no test uses a network."""

from __future__ import annotations

import os
import socket
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from siteloom.session import local_session

    session = local_session(4, **{"spark.sql.shuffle.partitions": 4, "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_network(monkeypatch):
    """Only this machine may be reached."""
    connect = socket.socket.connect

    def guarded(self, address, *args):
        if isinstance(address, tuple) and address[0] not in ("127.0.0.1", "::1", "localhost"):
            raise AssertionError(f"network access to {address}")
        return connect(self, address, *args)

    monkeypatch.setattr(socket.socket, "connect", guarded)


def rows(df):
    """Rows as sorted tuples, for comparing without regard to order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
