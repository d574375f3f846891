import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from docweave.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

# Document D of the fixtures: every JSON kind at the top level.
DOC_D = ('{"s":"5","n":5,"f":2.5,"b":true,"z":null,"o":{"x":{"y":"q"},"e":{}},'
         '"a":["x",5],"t":"l1\\nl2"}')


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", app="docweave-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def doc_d(spark):
    from docweave.sources.envelope import parse_documents
    return parse_documents(spark.createDataFrame([("e", DOC_D)], "entity string, map string"))


@pytest.fixture(scope="session")
def typed_d(spark):
    """Document D in typed mode (the schema cannot hold the empty object ``o.e``)."""
    schema = ("s string, n bigint, f double, b boolean, z string, "
              "o struct<x: struct<y: string>>, a array<string>, t string")
    return spark.createDataFrame(
        [("5", 5, 2.5, True, None, (("q",),), ["x", "5"], "l1\nl2")], schema)
