"""Counting operators in physical plans."""

import contextlib
import io


def full_plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def plan_of(df) -> str:
    """The tree part of the plan."""
    return full_plan(df).split("\n\n\n")[0]


def count(df, operator: str) -> int:
    """Nodes of the plan tree whose name starts with ``operator``."""
    tree = plan_of(df)
    names = [line.lstrip(" :+-*").split("(")[0].strip() for line in tree.splitlines()]
    return sum(name == operator for name in names)
