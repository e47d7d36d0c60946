import os

import pytest

TABLES = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
