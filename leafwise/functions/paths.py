"""Slash-separated paths as column expressions: normalise, join, make relative."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(path: Column) -> Column:
    """Path parts with ``.`` and empty parts removed and ``..`` resolved where possible."""
    absolute = path.startswith("/")
    names = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))

    def step(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        can_pop = (F.size(done) > 0) & (last != "..")
        return (
            F.when(part != "..", F.concat(done, F.array(part)))
            .when(can_pop, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
            .when(absolute, done)
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(names, F.array().cast("array<string>"), step)


def normalize_path(path: Column) -> Column:
    """Like POSIX ``normpath``: '' becomes '.', '..' climbs, repeated slashes collapse."""
    return folded_path(shortened_path(path))


def shortened_path(path: Column) -> Column:
    """A path of the same meaning with ``/./``, ``//`` and then each ``name/../`` cut out once; nested ``..`` stay."""
    cut = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"(?<![^/])(?!\.\.?/)[^/]+/\.\./", "")
    return F.when(_odd(path), cut).otherwise(path)


def folded_path(short: Column) -> Column:
    """The normal form of ``shortened_path``: most are normal, only the others go through the part-by-part fold.

    Spark compiles no operator that holds the fold; kept apart from the rest, it alone is interpreted.
    """
    return F.when(_odd(short), _folded(short)).otherwise(short)


def _odd(path: Column) -> Column:
    # Plain searches first: a pattern for all of it would be tried at every place of every path.
    dots = (path.contains("/.") | path.startswith(".")) & path.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return path.contains("//") | (path.endswith("/") & (path != "/")) | (path == "") | dots


def _folded(path: Column) -> Column:
    joined = F.array_join(_parts(path), "/")
    plain = F.when(joined == "", ".").otherwise(joined)
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).otherwise(plain)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def join_path(folder: Column, path: Column) -> Column:
    """Normalised ``folder/path``; an absolute path stays."""
    return normalize_path(F.when(path.startswith("/"), path).otherwise(F.concat(folder, F.lit("/"), path)))


def relative_path(path: Column, folder: Column) -> Column:
    """Path as seen from ``folder``; both absolute."""
    target, base = _parts(path), _parts(folder)
    same = F.zip_with(target, base, lambda a, b: F.coalesce(a == b, F.lit(False)))
    first_off = F.array_position(same, False)
    common = F.when(first_off == 0, F.size(same)).otherwise(first_off - 1).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(base) - common)
    down = F.slice(target, common + 1, F.greatest(F.size(target) - common, F.lit(0)))
    joined = F.array_join(F.concat(up, down), "/")
    return F.when(joined == "", ".").otherwise(joined)


def stored_path(path: Column, project_file: Column) -> Column:
    """Path as written into a project file: relative to the file's folder."""
    return relative_path(path, directory(project_file))


def loaded_path(path: Column, project_file: Column) -> Column:
    """Path as used after reading a project file."""
    return join_path(directory(project_file), path)
