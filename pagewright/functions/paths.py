"""Object keys and folder paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The optimised copy of ``/dir/name.ext`` is stored at
# ``/dir/name_optimized.ext``.  (?d) makes '.' and '$' treat only '\n' as a
# line end, as Python's re does.
OPTIMIZED_PATTERN = r"(?d)(.+)(/[^/.]+)(\..+)$"
OPTIMIZED_REPLACEMENT = "$1$2_optimized$3"
OBJECT_PREFIX = "users/"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def object_path(owner, path) -> Column:
    """Key of the uploaded original: ``users/{owner}{path}``."""
    return F.concat(F.lit(OBJECT_PREFIX), _c(owner).cast("string"), _c(path))


def optimized_path(path) -> Column:
    """Path of the optimised copy; equal to ``path`` when the pattern does not
    match (top-level file, no extension, dot-file)."""
    return F.regexp_replace(_c(path), OPTIMIZED_PATTERN, OPTIMIZED_REPLACEMENT)


def optimized_object_path(owner, path) -> Column:
    return F.concat(F.lit(OBJECT_PREFIX), _c(owner).cast("string"), optimized_path(path))


def parent_folder(path) -> Column:
    """String form of ``PurePosixPath(path).parent``.

    Empty and '.' segments are dropped, a trailing '/' is ignored, exactly two
    leading slashes are kept (POSIX), and a bare name has parent '.'.
    """
    p = _c(path)
    lead = (F.when(p.startswith("//") & ~p.startswith("///"), F.lit("//"))
            .when(p.startswith("/"), F.lit("/"))
            .otherwise(F.lit("")))
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    n = F.size(parts)
    up = F.concat(lead, F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), "/"))
    return (F.when(p.isNull(), F.lit(None))
            .when(n <= 1, F.when(lead == "", F.lit(".")).otherwise(lead))
            .otherwise(up))


def path_ancestors(folder) -> Column:
    """Tokens of a path-hierarchy analyzer: ``/a/b/c`` -> ``[/a, /a/b, /a/b/c]``
    and ``/`` -> ``[/]``."""
    f = _c(folder)
    parts = F.split(f, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, 1, i), "/"))
