"""Column functions over file paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(c: Column) -> Column:
    """Absolute path without empty, '.' and '..' segments."""
    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), kept)
            .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .otherwise(F.concat(kept, F.array(part)))
        )

    parts = F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step)
    # Paths without dot segments or doubled slashes, nearly all of them, need no folding.
    plain = ~c.rlike(r"//|/\.{1,2}(/|\z)") & ~c.endswith("/")
    return F.when(plain, c).otherwise(F.concat(F.lit("/"), F.array_join(parts, "/")))


def inside(path: Column, root: str) -> Column:
    root = root.rstrip("/")
    return (path == root) | path.startswith(root + "/")


def container_path_problem(c: Column, root: str) -> Column:
    """Reason a path is not absolute inside ``root``, or NULL."""
    return F.when(~c.startswith("/"), F.lit(f"path must be absolute and start with {root}")).when(
        ~inside(normalize_path(c), root), F.lit(f"path must be inside {root}")
    )


def quote_path(c: Column) -> Column:
    """Percent-encoded path segment; letters, digits and -_.~ stay."""
    encoded = F.url_encode(c)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded
