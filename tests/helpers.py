"""What several tests need."""

import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value that compares the same whichever engine it came from."""
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not isinstance(v, (int, float)):
        return tuple(plain(x) for x in (v if isinstance(v, (list, tuple)) else v.tolist()))
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same_rows(frame, con, sql):
    """Whether a frame and a SQL text give the same columns and rows."""
    names = sorted(frame.columns)
    mine = sorted((tuple(plain(r[n]) for n in names) for r in frame.collect()), key=repr)
    got = con.execute(sql)
    theirs_names = [d[0] for d in got.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert len(mine) == len(theirs)
    assert mine == theirs
