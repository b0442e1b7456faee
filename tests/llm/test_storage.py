"""After a query, the shared folder holds the tables that its result reads and no others."""

import glob
import os

import pytest

from stavelake.llm import queries
from stavelake.llm.common import shared_folder

#: What the results are read from.
READ = {
    "op1": {"profiles", "frequent-lines"}, "op2": {"statistics"}, "op5": {"kept-lines"}, "op6": {"shards"}, "op7": {"pages", "rank"}, "op8": {"scores"}, "op9": {"classes"}, "op10": {"windows"}, "op11": {"whitened"}, "op12": {"repaired"}, "op13": {"near-copies"},
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_only_what_the_result_reads_is_left(spark, small, name):
    folder = f"{shared_folder(spark)}/stavelake"
    before = set(glob.glob(f"{folder}/*"))
    df = queries.QUERIES[name](spark, small)
    left = {os.path.basename(p).rsplit("-", 1)[0] for p in set(glob.glob(f"{folder}/*")) - before}
    assert left == READ.get(name.split("_")[0], set())
    assert df.count() > 0
