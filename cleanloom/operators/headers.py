"""Headers of any kind: operators see names that expressions can hold; results have the table's own names again."""

from __future__ import annotations

import dataclasses
import functools
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of results whose values are names of columns.
NAMING = ("column", "column_name", "group", "feature", "a", "b", "c")


def plain(columns: Sequence[str]) -> dict[str, str]:
    """A plain name for each header that has dots, backticks or other marks; words stay words, and no two names are equal."""
    taken, out = {c.lower() for c in columns}, {}
    for c in dict.fromkeys(columns):
        if c and not re.search(r"[^\w \-]", c):
            continue
        base = re.sub(r"[^\w \-]+", "_", c).strip("_") or "column"
        name = next(n for k in range(len(columns) + 1) if (n := f"{base}_{k}" if k else base).lower() not in taken)
        taken.add(name.lower())
        out[c] = name
    return out


def any_header(f: Callable) -> Callable:
    """f, for tables with headers of any kind. Names in its arguments and results are the table's own."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        tables = [x for x in (*args, *kwargs.values()) if isinstance(x, DataFrame)]
        to = plain([c for t in tables for c in t.columns])
        if not to:
            return f(*args, **kwargs)
        own = {c for t in tables for c in t.columns}
        return _mapped(f(*_mapped(args, to), **_mapped(kwargs, to)), {v: k for k, v in to.items()}, own)

    return run


def _mapped(x, to: dict[str, str], own: set[str] | None = None):
    """x with other names, in whatever holds them. With own (the names of the operator's tables), the values of columns NAMING are names as well, but for such a column of a table that has come through."""
    if isinstance(x, str):
        return to.get(x, x)
    if isinstance(x, DataFrame):
        if any(c in to for c in x.columns):
            x = x.toDF(*(to.get(c, c) for c in x.columns))
        kinds = dict(x.dtypes)
        for c in [c for c in NAMING if own is not None and kinds.get(c) == "string" and not (c in own and any(d in own for d in x.columns if d != c))]:
            names = F.create_map(*(F.lit(n) for pair in to.items() for n in pair))
            x = x.withColumn(c, F.coalesce(names[F.col(c)], F.col(c)))
        return x
    if dataclasses.is_dataclass(x) and not isinstance(x, type):
        return dataclasses.replace(x, **{f.name: _mapped(getattr(x, f.name), to, own) for f in dataclasses.fields(x) if f.init})
    if isinstance(x, dict):
        return {_mapped(k, to, own): _mapped(v, to, own) for k, v in x.items()}
    if type(x) in (list, tuple):
        return type(x)(_mapped(y, to, own) for y in x)
    return x
