"""Order-insensitive value digest shared by the tests (same rule as scripts/check_oracle.py)."""

import hashlib
import math

import pandas as pd


def norm_value(v, digits=9):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v == int(v) and abs(v) < 2 ** 53:
            return repr(int(v))
        return repr(round(v, digits) + 0.0)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "item"):
        return norm_value(v.item(), digits)
    return repr(v)


def digest(df, digits=9):
    cols = sorted(df.columns)
    rows = sorted("|".join(norm_value(r[c], digits) for c in cols) for r in df[cols].to_dict("records"))
    return hashlib.sha1("\n".join(rows).encode()).hexdigest(), rows
