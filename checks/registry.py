"""Name to query and to the SQL that answers the same question."""

QUERIES: dict = {}
ORACLES: dict = {}


def query(name, run, oracle=None):
    assert name not in QUERIES, name
    QUERIES[name] = run
    if oracle:
        ORACLES[name] = oracle
